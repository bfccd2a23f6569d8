"""The rules of ``sarnai.functions.text`` as SQL expressions of the oracle's dialect, whose regular expressions cannot look around.

Literal rules come from the same tables; a context that a rule looks at is captured and written back instead.
"""

from __future__ import annotations

from collections.abc import Callable

from sarnai.functions import text as T

NL = "chr(10)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rewrite(expr: str, rules: list[tuple[str, str]], contexts: dict[str, tuple[str, str]] | None = None) -> str:
    """Nested replaces; contexts: what stands for a rule that is a regular expression."""
    for source, target in rules:
        if source.startswith("~"):
            pattern, made = contexts[source]
            expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(made)}, 'g')"
        else:
            expr = f"replace({expr}, {_quoted(source)}, {_quoted(target)})"
    return expr


def per_line(expr: str, rule: Callable[[str], str]) -> str:
    return f"array_to_string(list_transform(string_split({expr}, {NL}), lambda l: {rule('l')}), {NL})"


def dashes(expr: str) -> str:
    for pattern, before, after in ((r"[ \t]*[‒-―−][ \t]*", "", ""), (r"[ \t]+-[ \t]+", "", ""), (r"[ \t]+-\n", "", NL), (r"\n-[ \t]+", NL, ""), (r"\n-\n", NL, NL)):
        made = " || ".join(x for x in (before, "' ︱ '", after) if x)
        expr = f"regexp_replace({expr}, '{pattern}', {made}, 'g')"
    return expr


def to_todo(expr: str) -> str:
    contexts = {r"~(?U)(?<![\w:])ǰ(?=[aou])": (r"(^|[^\pL\pN_:])ǰ([aou])", r"\1J\2"), "~k(?=[aou])": ("k([aou])", r"ᡗ\1")}
    rom = _rewrite(f"lower({dashes(expr)})", T.TRANSLIT_RULES, contexts)
    return f"translate({_rewrite(rom, T.DIGRAPHS)}, {_quoted(T.LETTERS_FROM)}, {_quoted(T.LETTERS_TO)})"


def todo_to_rom(expr: str) -> str:
    expr = rf"regexp_replace({expr}, 'ᠴ(ᡅ)', 'j\1', 'g')"
    for letter, front, back, other in T.ASCII_BY_NEXT:
        for vowels, made in ((T.FRONT_TODO, front), (T.BACK_TODO, back)):
            expr = rf"regexp_replace({expr}, '{letter}([{vowels}])', '{made}\1', 'g')"
        expr = f"replace({expr}, '{letter}', '{other}')"
    return f"translate({_rewrite(expr, T.ASCII_LONG)}, {_quoted(T.ASCII_FROM)}, {_quoted(T.ASCII_TO)})"


def todo_to_translit(expr: str) -> str:
    """A line shares one decision on harmony."""
    harmony = "CASE WHEN regexp_matches(regexp_extract(l, '[aāoōuūeēiīöȫüǖ]'), '[eēiīöȫüǖ]') THEN 'k' ELSE 'x' END"
    rom = f"list_transform(string_split({expr}, {NL}), lambda l: {todo_to_rom('l')})"
    return f"array_to_string(list_transform({rom}, lambda l: replace({_rewrite('l', T.REVERSE_RULES)}, 'h', {harmony})), {NL})"


def strip_marks(expr: str) -> str:
    return per_line(expr, lambda x: f"trim(regexp_replace(regexp_replace({x}, {_quoted(f'[{T.MARKS}]+')}, ' ', 'g'), ' {{2,}}', ' ', 'g'), ' ')")


def frame(column: str) -> str:
    lines = f"string_split({column}, {NL})"
    filled = rf"list_filter(list_transform({lines}, lambda l, i: CASE WHEN regexp_matches(l, '\S') THEN i END), lambda i: i IS NOT NULL)"
    end = rf"regexp_replace(regexp_replace(l, '\s+$', ''), '[{T.SRC_STOP}{T.FULL_STOP}]$', '') || '{T.FOUR_DOTS}'"
    made = f"CASE WHEN i = list_max({filled}) THEN {end} ELSE l END"
    marked = f"list_transform({lines}, lambda l, i: CASE WHEN i = list_min({filled}) THEN '{T.BIRGA}' || ltrim({made}, ' ') ELSE {made} END)"
    return f"CASE WHEN len({filled}) = 0 THEN {column} ELSE array_to_string({marked}, {NL}) END"


def punctuation(table: str, key: str, todo: str) -> str:
    """The query for key and the three modes."""
    trimmed = per_line(todo, lambda x: f"trim({x}, ' ')")
    return f"""SELECT {key}, off, CASE WHEN {todo} = '' THEN {todo} ELSE {frame('off')} END AS frame,
      CASE WHEN {todo} = '' THEN {todo} ELSE translate({frame('every')}, '{T.SRC_STOP}', '{T.FULL_STOP}') END AS "all"
      FROM (SELECT *, {strip_marks(todo)} AS off, translate({trimmed}, '{T.SRC_COMMA}', '{T.COMMA}') AS every FROM ({table}))"""


WORD = "᠋-᠏ᠠ-ᢪ"


def _steps(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, made in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{made}', 'g')"
    return expr


def round_harmony(word: str) -> str:
    """word: the name of a lambda's argument."""
    marked = "([ᡋᡌ][᠋-᠏]?)[ᡆᡉ]"
    others = rf"regexp_replace({word}, '{marked}', '\1', 'g')"
    count = lambda letters: f"len(regexp_extract_all({others}, '[{letters}]'))"
    back, front = count("ᠠᡆᡇ"), count("ᡄᡈᡉ")
    change = lambda vowel: rf"regexp_replace({word}, '{marked}', '\1{vowel}', 'g')"
    return f"CASE WHEN {back} > {front} THEN {change('ᡆ')} WHEN {back} < {front} THEN {change('ᡉ')} ELSE {word} END"


def normalize_ocr(expr: str) -> str:
    letters, vowels, consonants = T.TODO_LETTERS, T.TODO_VOWELS, T.TODO_CONSONANTS
    expr = _steps(expr, [
        (r"ᡓ(ᡅ)", r"ᠴ\1"), (rf"(^|[^{WORD}])ᡓ([ᠠᡆᡇ])", r"\1ᡚ\2"),
        (rf"([{consonants}])ᡃ([{vowels}])ᡃ?", r"\1\2ᡃ"), (rf"([{consonants}])ᡃ", r"\1"), (rf"ᡅᡅᠠ([^{letters}]|$)", r"ᡅᡕᡅᠨ\1"), (r"ᡅᡅ([︕︖])", r"ᡅ\1"),
        (rf"([{T.NOT_AFTER_N}])ᠨ([^{WORD}]|$)", r"\1ᠠ\2"),
    ])
    expr = f"array_to_string(list_transform(regexp_extract_all({expr}, '[{WORD}]+|[^{WORD}]+'), lambda w: {round_harmony('w')}), '')"
    alone = (rf"(^|[^{letters}])(ᡅ(?:ᠨ|ᡎᡅ))([^{letters}]|$)", r"\1ᡕ\2\3")  # twice, as neighbours share the character between them
    return _steps(expr, [(rf"([{vowels}ᡃ])ᡅ([{consonants}])", r"\1ᡕᡅ\2"), alone, alone])
