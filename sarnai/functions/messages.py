"""Incoming updates, settings and replies as columns: parsing, routing, buttons, reply texts, splitting."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sarnai.functions.text import fmt_ms, plural, upper_one

# Limits, choices and reply texts that results depend on.
MESSAGE_LIMIT, LINE_LIMIT, ATTACHMENTS, FIXES_SHOWN = 4096, 3500, 10, 12
LABEL_LIMIT, PAYLOAD_BYTES, COLORS_PER_PAGE = 40, 255, 8
CHAT_PEERS = 2_000_000_000
MODES = ("translit", "todo", "image", "fix")
COMMANDS = ("start", "help", "mode", *MODES, "ocr", "settings", "stats", "export")
PUNCTUATION = ("off", "frame", "all")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif", "heic")
PHOTO_RATIO, PHOTO_SIDES = 19, 14_000
TRUE_WORDS = ("1", "true", "yes", "y", "on", "да")
HEADERS = {"translit": "🔤 Транслитерация", "todo": "ᡐ Тодо бичик", "image": "🖼 Картинка", "fix": "✏️ Исправление"}
LABEL_CYRILLIC, LABEL_TRANSLIT, LABEL_TODO = "Кириллица:", "Транслитерация:", "Тодо бичик:"
FIX_TITLE = "Исправленный текст:"
FIX_NOTHING = "Ошибок не нашёл: калмыцкие буквы на месте, незнакомых слов, которые я умею исправить, нет."
LETTERS_FIXED, LETTERS_MORE = "✏️ Вернул калмыцкие буквы: ", " и ещё "
LETTERS_HINT = (
    "💡 Похоже, текст набран без калмыцких букв (ә ө ү һ җ ң) — перевод может быть неточным. "
    "Бот умеет их восстанавливать: включите это в настройках (/settings)."
)
OCR_TITLE = "📷 Текст с фото · столбцов: "
OCR_LOW_CONFIDENCE = "⚠️ Модель не уверена: возможно, на фото не тодо бичик или текст плохо читается."

MESSAGE = (
    "message struct<from_id:long,peer_id:long,text:string,payload:string,conversation_message_id:long,"
    "attachments:array<struct<type:string,photo:struct<id:long,owner_id:long,orig_photo:struct<url:string>,sizes:array<struct<url:string,width:int,height:int>>>,"
    "doc:struct<id:long,owner_id:long,ext:string,url:string,size:long>>>>, client_info struct<button_actions:array<string>,keyboard:boolean,inline_keyboard:boolean>"
)
PRESS = "user_id long, peer_id long, event_id string, payload string, conversation_message_id long"


def payload(raw: Column) -> Column:
    """The JSON object as a map of texts; null for anything else."""
    shaped = F.when(F.regexp_like(raw, F.lit(r"^\s*\{")) & F.try_parse_json(raw).isNotNull(), raw)
    return F.from_json(shaped, "map<string,string>")


def parse_message(obj: Column) -> Column:
    """struct of a message_new object; peer_id falls back to from_id, texts to empty, the client to plain text buttons."""
    o = F.from_json(obj, MESSAGE)
    m, client = o["message"], o["client_info"]
    actions = F.when(F.size(client["button_actions"]) > 0, client["button_actions"]).otherwise(F.array(F.lit("text")))
    return F.struct(
        F.coalesce(F.nullif(m["peer_id"], F.lit(0)), m["from_id"]).alias("peer_id"), F.coalesce(m["from_id"], F.lit(0)).alias("from_id"),
        F.coalesce(m["text"], F.lit("")).alias("text"), payload(m["payload"]).alias("payload"),
        F.coalesce(m["attachments"], F.array().cast("array<struct<type:string,photo:struct<id:long,owner_id:long,orig_photo:struct<url:string>,sizes:array<struct<url:string,width:int,height:int>>>,doc:struct<id:long,owner_id:long,ext:string,url:string,size:long>>>")).alias("attachments"),
        m["conversation_message_id"].alias("conversation_message_id"), actions.alias("button_actions"),
        F.array_contains(actions, "callback").alias("callback"), F.coalesce(client["keyboard"], F.lit(True)).alias("keyboard"),
        F.coalesce(client["inline_keyboard"], F.lit(True)).alias("inline_keyboard"),
    )


def parse_press(obj: Column) -> Column:
    o = F.from_json(obj, PRESS)
    return o.withField("payload", F.coalesce(payload(o["payload"]), F.create_map().cast("map<string,string>")))


def largest(sizes: Column) -> Column:
    """URL of the largest area; ties: the first."""
    area = lambda s: F.coalesce(s["width"], F.lit(0)) * F.coalesce(s["height"], F.lit(0))
    ranked = F.transform(sizes, lambda s, i: F.struct(area(s).alias("area"), (-i).alias("at"), s["url"].alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


def pick_attachment(attachments: Column) -> Column:
    """struct(kind, url, ref): the first picture; without one, what the first other file is; else null."""

    def one(a: Column) -> Column:
        photo, doc = a["photo"], a["doc"]
        ext = F.lower(F.coalesce(doc["ext"], F.lit("")))
        kind = F.when((a["type"] == "photo") | ext.isin(*IMAGE_EXTENSIONS), "image").when(ext == "pdf", "pdf").otherwise("other")
        url = F.when(a["type"] == "photo", F.coalesce(F.nullif(photo["orig_photo"]["url"], F.lit("")), largest(photo["sizes"]))).otherwise(F.coalesce(doc["url"], F.lit("")))
        ref = F.when(a["type"] == "photo", F.concat(F.lit("photo"), photo["owner_id"], F.lit("_"), photo["id"])).otherwise(F.concat(F.lit("doc"), doc["owner_id"], F.lit("_"), doc["id"]))
        return F.struct(kind.alias("kind"), F.when(kind == "image", url).otherwise("").alias("url"), F.when(kind == "image", ref).otherwise("").alias("ref"))

    files = F.transform(F.filter(attachments, lambda a: a["type"].isin("photo", "doc")), one)
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    return F.coalesce(first(F.filter(files, lambda f: f["kind"] == "image")), first(files))


def route_message(from_id: Column, peer_id: Column, text: Column, keys: Column, command: Column, pending: Column, addressed: Column, has_file: Column) -> Column:
    """Where a message goes, by precedence. command: struct(name, args) or null; pending: a correction is awaited."""
    blank = F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0
    filled = lambda k: F.coalesce(F.try_element_at(keys, F.lit(k)), F.lit("")) != ""
    return (
        F.when(from_id <= 0, "drop").when(filled("a"), "action").when(filled("cmd") | filled("command"), "command")
        .when((peer_id >= CHAT_PEERS) & ~(addressed | command.isNotNull() | pending), "drop").when(command.isNotNull(), "command")
        .when(pending & blank, "ask_again").when(pending, "correction").when(has_file, "image").when(~blank, "text").otherwise("hint")
    )


def run_command(name: Column) -> Column:
    """struct(action, clears): every name but cancel clears a pending correction, a null one (no such command) does not."""
    action = F.when(name.isNull(), "unknown").when(name == "cancel", "cancel").when(name.isin(*MODES), "switch").when(name.isin(*COMMANDS), name).otherwise("unknown")
    return F.struct(action.alias("action"), F.coalesce(name != "cancel", F.lit(False)).alias("clears"))


def route_action(keys: Column) -> Column:
    a = F.try_element_at(keys, F.lit("a"))
    return F.when(a == "fb", "rating").when(a == "conv", "convert").when(a == "set", "settings").otherwise("none")


# settings
def valid(value: Column, choices: tuple[str, ...], default: str | None) -> Column:
    return F.when(value.isin(*choices), value).otherwise(F.lit(default))


def valid_mode(mode: Column) -> Column:
    return valid(mode, MODES, "translit")


def show_time(value: Column) -> Column:
    return ~value.eqNullSafe(F.lit("off"))


def fix_letters(value: Column) -> Column:
    return F.coalesce(value == "on", F.lit(False))


def photo_ok(width: Column, height: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    fits = (F.greatest(w, h) <= PHOTO_RATIO * F.least(w, h)) & (w + h <= PHOTO_SIDES)
    return F.when((w == 0) | (h == 0), True).otherwise(fits)


def resolve_color(name: Column, palette: dict[str, str], fallback: Column) -> Column:
    """palette: lower-cased alias to colour; a closed list of a few names, so a map and no join."""
    known = F.create_map(*(F.lit(x) for pair in palette.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), fallback)


def text_and_ground(fg: Column, bg: Column) -> Column:
    """Equal colours become black on white, and say so."""
    same = fg.eqNullSafe(bg)
    return F.struct(F.when(same, "black").otherwise(fg).alias("fg"), F.when(same, "white").otherwise(bg).alias("bg"), same.alias("fallback"))


def is_true(value: Column, default: bool) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS), F.lit(default))


def int_list(value: Column) -> Column:
    """Numbers between commas or semicolons; others are left out."""
    parts = F.split(F.coalesce(value, F.lit("")), "[;,]")
    return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("long")), lambda n: n.isNotNull())


def now(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def source_text(target: Column, letters_json: Column, input_text: Column) -> Column:
    fixed = F.nullif(F.get_json_object(letters_json, "$.text"), F.lit(""))
    return F.when(target == "fix", F.coalesce(fixed, input_text)).otherwise(input_text)


def letters_log(target: Column, enabled: Column, flag: Column, fixes: Column, text: Column) -> Column:
    some = (F.coalesce(flag, F.lit("")) != "") | (F.coalesce(F.size(fixes), F.lit(0)) > 0)
    base = F.to_json(F.struct(enabled.alias("enabled"), flag.alias("flag"), fixes.alias("fixes")), {"ignoreNullFields": "false"})
    whole = F.to_json(F.struct(F.lit(True).alias("enabled"), flag.alias("flag"), fixes.alias("fixes"), text.alias("text")), {"ignoreNullFields": "false"})
    return F.when(target == "fix", whole).when(some, base)


def flatten(params: Column) -> Column:
    """map<string,variant text> of JSON values: nulls go, true and false are 1 and 0, lists are joined by commas."""
    listed = lambda v: F.array_join(F.from_json(v, "array<string>"), ",")
    plain = lambda v: F.when(v == "true", "1").when(v == "false", "0").when(v.startswith("["), listed(v)).when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    return F.transform_values(F.map_filter(params, lambda _, v: v.isNotNull() & (v != "null")), lambda _, v: plain(v))


# buttons
def button_label(label: Column) -> Column:
    return F.when(F.length(label) > LABEL_LIMIT, F.concat(F.substring(label, 1, LABEL_LIMIT - 1), F.lit("…"))).otherwise(label)


def payload_fits(raw: Column) -> Column:
    return F.octet_length(raw) <= PAYLOAD_BYTES


def chunks(items: Column, size: int) -> Column:
    """Consecutive slices of at most size items."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0)))
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(starts, lambda k: F.slice(items, k * size + 1, size)))


def palette_page(items: Column, page: Column, size: int = COLORS_PER_PAGE) -> Column:
    """struct(page, pages, items): the page is brought into range."""
    pages = F.greatest(F.ceil(F.size(items) / size).cast("int"), F.lit(1))
    at = F.least(F.greatest(page, F.lit(0)), pages - 1)
    return F.struct(at.alias("page"), pages.alias("pages"), F.slice(items, at * size + 1, size).alias("items"))


# replies
def timing(ms: Column) -> Column:
    return F.concat(F.lit("⏱ "), fmt_ms(ms))


def letters_note(fixes: Column, flag: Column) -> Column:
    """fixes: array<struct<before,after>>. The first few pairs and how many more; a hint if only flagged; else null."""
    n = F.coalesce(F.size(fixes), F.lit(0))
    pairs = F.array_join(F.transform(F.slice(fixes, 1, FIXES_SHOWN), lambda p: F.concat(p["before"], F.lit(" → "), p["after"])), ", ")
    more = F.when(n > FIXES_SHOWN, F.concat(F.lit(LETTERS_MORE), (n - FIXES_SHOWN).cast("string"))).otherwise("")
    return F.when(n > 0, F.concat(F.lit(LETTERS_FIXED), pairs, more)).when(F.coalesce(flag, F.lit("")) != "", LETTERS_HINT)


def _titled(title: str, body: Column) -> Column:
    return F.concat(F.lit(title + "\n"), F.coalesce(body, F.lit("")))


def render(target: Column, script: Column, translit: Column, todo: Column, cyrillic: Column, fixed: Column, fixes: Column, flag: Column, ms: Column, timed: Column) -> Column:
    """The reply to a text: blocks joined by a blank line; missing blocks leave nothing."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    header = reduce(lambda c, t: c.when(target == t, HEADERS[t]), HEADERS, F.when(F.lit(False), "")).otherwise(F.concat(F.lit("• "), target))
    cyr = (target == "translit") & has(cyrillic)
    other = ~target.isin("translit", "fix")
    fixed_any = (target == "fix") & (F.coalesce(F.size(fixes), F.lit(0)) > 0)
    blocks = [
        header,
        F.when(cyr & (script != "translit"), _titled(LABEL_TRANSLIT, translit)), F.when(cyr, _titled(LABEL_CYRILLIC, cyrillic)),
        F.when((target == "translit") & ~cyr, F.coalesce(translit, F.lit(""))),
        F.when(other & has(translit), _titled(LABEL_TRANSLIT, translit)), F.when(other, _titled(LABEL_TODO, todo)),
        F.when(fixed_any, _titled(FIX_TITLE, fixed)), F.when((target == "fix") & ~fixed_any, FIX_NOTHING),
        F.when((target != "fix") | fixed_any, letters_note(fixes, flag)), F.when(timed, timing(ms)),
    ]
    return F.concat_ws("\n\n", *blocks)


def line_blocks(title: str, lines: Column, limit: int = LINE_LIMIT) -> Column:
    """Lines filled greedily into blocks up to a length; the title is on the first."""

    def put(acc: Column, line: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(line) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), line)))).otherwise(F.concat(acc, F.array(line)))

    made = F.aggregate(lines, F.array().cast("array<string>"), put)
    made = F.when(F.size(made) == 0, F.array(F.lit(""))).otherwise(made)
    return F.transform(made, lambda b, i: F.when(i == 0, F.concat(F.lit(title + "\n"), b)).otherwise(b))


def pack_blocks(blocks: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """Blocks joined by a blank line into messages while they fit."""

    def put(acc: Column, block: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 2 + F.length(block) <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), block)))).otherwise(F.concat(acc, F.array(block)))

    return F.aggregate(blocks, F.array().cast("array<string>"), put)


def render_ocr(columns: Column, translit: Column, cyrillic: Column, unreadable: Column, unsure: Column, ms: Column, timed: Column) -> Column:
    """Messages of a page's reading: a line per column in each script."""
    title = F.array(F.concat(F.lit(OCR_TITLE), F.size(columns).cast("string")))
    none = F.array().cast("array<string>")
    optional = lambda on, c: F.when(on, F.array(c)).otherwise(none)
    bad = F.concat(F.lit("⚠️ Не разобрал "), plural(unreadable), F.lit(": текст там размыт, в ответе их нет. Снимите эту часть страницы крупнее и резче."))
    blocks = F.concat(
        title, F.when(F.size(cyrillic) > 0, line_blocks(LABEL_CYRILLIC, cyrillic)).otherwise(none), line_blocks(LABEL_TRANSLIT, translit),
        line_blocks(LABEL_TODO, columns), optional(unreadable > 0, bad), optional(unsure, F.lit(OCR_LOW_CONFIDENCE)), optional(timed, timing(ms)),
    )
    return pack_blocks(blocks)


def cut_message(text: str, limit: int = MESSAGE_LIMIT) -> list[str]:
    """Pieces within the limit: broken at the last blank line, else the last line end, else anywhere."""
    pieces = []
    while len(text) > limit:
        at = next((p for p in (text.rfind("\n\n", 0, limit), text.rfind("\n", 0, limit)) if p > 0), limit)
        pieces.append(text[:at].rstrip())
        text = text[at:].lstrip("\n")
    return pieces + [text] if text or not pieces else pieces


def split_text(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """The pieces to send. Texts within the limit stay native; only longer ones go to Python."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_message(t, limit))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.pandas_udf(cut, "array<string>")(F.when(F.length(text) > limit, text)))


def capitalize_sentences(text: Column, blank: str = r"\s") -> Column:
    """The first letter of the text and of what follows an end mark and blanks, in upper case, one letter for one; all else stays, a final line end too."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?sU)(?:^|\G)(.*?(?:[.!?]{blank}+|\z))"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(upper_one(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


# pages of columns
def page_starts(widths: Column, new_line: Column, most: int, column_gap: int, line_gap: int, margin: int) -> Column:
    """Of each column: struct(page, x). A page's first column has no gap before it."""
    pairs = F.arrays_zip(widths.alias("w"), new_line.alias("n"))
    start = F.struct(F.lit(0).alias("page"), F.lit(margin).alias("end"), F.array().cast("array<struct<page:int,x:int>>").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        empty = acc["end"] == margin
        gap = F.when(empty, 0).when(c["n"], line_gap).otherwise(column_gap)
        over = ~empty & (acc["end"] + gap + c["w"] + margin > most)
        page, x = acc["page"] + over.cast("int"), F.when(over, F.lit(margin)).otherwise(acc["end"] + gap)
        return F.struct(page.alias("page"), (x + c["w"]).alias("end"), F.concat(acc["out"], F.array(F.struct(page.alias("page"), x.alias("x")))).alias("out"))

    return F.aggregate(pairs, start, put, lambda acc: acc["out"])


def wrap_words(widths: Column, blank: int, most: int) -> Column:
    """Line number of each word by measured width; a word that is too wide stands alone."""
    start = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, w: Column) -> Column:
        fits = (acc["line"] >= 0) & (acc["used"] + blank + w <= most)
        line = F.when(fits, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(fits, acc["used"] + blank + w).otherwise(w).alias("used"), F.concat(acc["out"], F.array(line)).alias("out"))

    return F.aggregate(widths, start, put, lambda acc: acc["out"])


def quality_scale(width: Column, height: Column, target: int = 1200, most: int = 6) -> Column:
    return F.least(F.lit(float(most)), F.greatest(F.lit(1.0), F.lit(float(target)) / F.greatest(width, height)))


def column_height(font_size: Column) -> Column:
    return F.floor(font_size * 900 / 64).cast("int")
