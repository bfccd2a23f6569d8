"""Presses of the settings panel and of the rating buttons, and captions of pictures, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sarnai.functions.messages import HEADERS, PUNCTUATION, letters_note, timing

# Choices and replies that results depend on.
SIZES = ("small", "medium", "large")
PALETTE = {
    "black": ("чёрный", "⬛"), "white": ("белый", "⬜"), "red": ("красный", "🟥"), "orange": ("оранжевый", "🟧"), "yellow": ("жёлтый", "🟨"), "green": ("зелёный", "🟩"),
    "blue": ("синий", "🟦"), "purple": ("фиолетовый", "🟪"), "brown": ("коричневый", "🟫"), "gold": ("золотой", "🟡"), "transparent": ("прозрачный", "▫️"),
}
ON_OFF = {"fix_letters": ("Буду исправлять", "Не буду исправлять"), "show_time": ("Буду показывать время работы", "Время работы больше не показываю")}
SAVED, RESET = "Сохранил", "Вернул настройки по умолчанию"
SAME_COLOR = "Цвет текста и фона теперь совпадают — на такой картинке ничего не видно. Пока они одинаковые, буду рисовать чёрным по белому."
UNKNOWN_REQUEST = "Это сообщение слишком старое. Сделайте перевод заново."
THANKS = "Спасибо! Отметил как верный вариант 👍"
ASK_CORRECTION = (
    "Понял, вариант неудачный 👎\n\nПришлите, пожалуйста, правильный ответ одним сообщением — сохраню его вместе с тем, что выдал бот.\n\n"
    "Если не хочется расписывать — /cancel, минус всё равно зачтётся."
)
NOT_SHAPED = "⚠️ Буквы на картинке не соединены — на сервере не хватает библиотеки. Напишите администратору бота."
COLOR_FALLBACK = "⚠️ Цвет текста совпал с фоном — нарисовал чёрным по белому. /settings"
PAGES_DROPPED = ("⚠️ Текст не поместился целиком: не хватило ещё ", " картинок. Пришлите его частями.")
PAGES = (" · картинки ", "–", " из ")


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def color_label(key: Column) -> Column:
    """Chip and name of a palette colour; the key itself for any other."""
    return F.coalesce(F.try_element_at(_map({k: f"{chip} {name}" for k, (name, chip) in PALETTE.items()}), key), key)


def settings_press(keys: Column, fg: Column, bg: Column, fix: Column, timed: Column, fonts: tuple[str, ...]) -> Column:
    """struct(field, value, resets, notice, alert, screen) of a press, given what is set now.

    field and value: what to write; screen: which menu to draw next (null: none). An unknown press only gets its answer.
    A ground may be transparent, a text colour may be any of the palette as well: both fields take the whole list."""
    get = lambda k: F.coalesce(F.try_element_at(keys, F.lit(k)), F.lit(""))
    do, field, value = get("do"), get("f"), get("v")
    picks = field.isin("size", "font", "punctuation", "fg", "bg")
    colour = field.isin("fg", "bg")
    sets = (
        (colour & value.isin(*PALETTE)) | ((field == "size") & value.isin(*SIZES)) | ((field == "font") & value.isin(*fonts)) | ((field == "punctuation") & value.isin(*PUNCTUATION))
    )
    sets = (do == "set") & sets
    toggles = (do == "toggle") & field.isin(*ON_OFF)
    now = F.when(field == "fix_letters", fix).otherwise(timed)
    told = F.when(field == "fix_letters", F.when(now, ON_OFF["fix_letters"][1]).otherwise(ON_OFF["fix_letters"][0])).otherwise(F.when(now, ON_OFF["show_time"][1]).otherwise(ON_OFF["show_time"][0]))
    same = sets & colour & (F.when(field == "fg", value).otherwise(fg) == F.when(field == "bg", value).otherwise(bg))
    return F.struct(
        F.when(sets | toggles, field).alias("field"),
        F.when(sets, value).when(toggles, F.when(now, "off").otherwise("on")).alias("value"),
        (do == "reset").alias("resets"),
        F.when(toggles, told).when(same, SAME_COLOR).when(sets, SAVED).when(do == "reset", RESET).alias("notice"),
        same.alias("alert"),
        F.when((do == "pick") & picks, F.concat(F.lit("pick "), field)).when(sets | toggles | do.isin("back", "reset"), "menu").alias("screen"),
    )


def rating_press(value: Column, request: Column, known: Column) -> Column:
    """struct(action, rating, notice) of a vote: ``request`` is the id it names (null: none), ``known`` whether that is in the log."""
    valid = F.coalesce(value.isin("up", "down"), F.lit(False)) & request.isNotNull()
    kept = valid & F.coalesce(known, F.lit(False))
    return F.struct(
        F.when(~valid, "answer").when(~kept, "unknown").when(value == "up", "thank").otherwise("await").alias("action"),
        F.when(kept, value).alias("rating"),
        F.when(valid & ~kept, UNKNOWN_REQUEST).when(kept & (value == "up"), THANKS).when(kept, ASK_CORRECTION).alias("notice"),
    )


def image_caption(first: Column, last: Column, total: Column, shaped: Column, recolored: Column, dropped: Column, fixes: Column, flag: Column, ms: Column, timed: Column, final: Column) -> Column:
    """The text under pictures first to last of total: warnings under the first batch, the time under the last."""
    part = F.concat(F.lit(PAGES[0]), first.cast("string"), F.lit(PAGES[1]), last.cast("string"), F.lit(PAGES[2]), total.cast("string"))
    header = F.concat(F.lit(HEADERS["image"]), F.when(total > last - first + 1, part).otherwise(""))
    opening = first == 1
    left = F.concat(F.lit(PAGES_DROPPED[0]), dropped.cast("string"), F.lit(PAGES_DROPPED[1]))
    return F.concat_ws(
        "\n\n", header, F.when(opening & ~shaped, NOT_SHAPED), F.when(opening & recolored, COLOR_FALLBACK), F.when(opening & (dropped > 0), left),
        F.when(opening, letters_note(fixes, flag)), F.when(final & timed, timing(ms)),
    )


def sheets(widths: Column, heights: Column, new_line: Column, most: int, column_gap: int, line_gap: int, margin: int, most_pages: int) -> Column:
    """struct(pages: array<struct<first,n,width>>, height, truncated): columns of measured sizes put on sheets no wider than ``most``.

    All sheets share the height of the tallest column; sheets beyond ``most_pages`` are counted, not drawn."""
    every = F.arrays_zip(widths.alias("w"), new_line.alias("nl"))
    page = "struct<first:int,n:int,width:int>"

    def put(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.when(c["nl"], line_gap).otherwise(column_gap)
        fits = last.isNotNull() & (last["width"] + gap + c["w"] <= most)
        grown = F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"), (last["width"] + gap + c["w"]).alias("width")).cast(page)
        begun = F.struct(F.coalesce(last["first"] + last["n"], F.lit(0)).alias("first"), F.lit(1).alias("n"), (c["w"] + 2 * margin).alias("width")).cast(page)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(begun)))

    made = F.aggregate(every, F.array().cast(f"array<{page}>"), put)
    return F.struct(
        F.slice(made, 1, most_pages).alias("pages"), (F.coalesce(F.array_max(heights), F.lit(0)) + 2 * margin).alias("height"), F.greatest(F.size(made) - most_pages, F.lit(0)).alias("truncated")
    )
