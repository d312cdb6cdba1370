"""Pieces of DuckDB SQL for the oracles of the text layer, written apart from the engine's expressions."""

from __future__ import annotations

from larder.functions import text as T

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_SPACES = "    　"
#: Compatibility forms that occur in the test tables.
_COMPAT = (("ﬁ", "fi"), ("ﬂ", "fl"), ("‑", "‐"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def nfkc(x: str) -> str:
    wide = f"translate(translate({x}, '{_WIDE}', '{_NARROW}'), '{_SPACES}', '{' ' * len(_SPACES)}')"
    for a, b in _COMPAT:
        wide = f"replace({wide}, '{a}', '{b}')"
    return f"nfc_normalize({wide})"


def key(x: str) -> str:
    body = strip(collapse(f"translate({strip(f'lower({nfkc(x)})')}, '-_', '  ')"))
    return f"CASE WHEN {blank(x)} THEN '' ELSE {body} END"


def clean(x: str) -> str:
    body = strip(f"translate({collapse(strip(nfkc(x)))}, '-_', '  ')")
    return f"CASE WHEN {blank(x)} THEN '' ELSE {body} END"


def printable(x: str, most: int | None = None) -> str:
    body = strip(collapse(f"regexp_replace({collapse(strip(x))}, '[^\\x20-\\x7E\\x{{C0}}-\\x{{FF}}]', ' ', 'g')"))
    body = f"substr({body}, 1, {most})" if most else body
    return f"CASE WHEN {blank(x)} THEN '' ELSE {body} END"


def clean_token(x: str) -> str:
    for pattern, to in (
        (rf"{WS}*\d+[.,]?\d*{WS}*%", ""), (rf"^\d+{WS}+", ""), (rf"(?i)\b\d+{WS}*(?:{'|'.join(T.MEASURES)})\b", ""),
        (rf"(?i){WS}+for{WS}+(?:{'|'.join(T.PURPOSES)})\b.*$", ""), (r"([a-z])\d+$", r"\1"), (rf"{WS}+\d+$", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return strip(x)


def is_e_code(x: str) -> str:
    return f"regexp_matches(lower({strip(x)}), '{T.E_CODE}')"


def e_code(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN regexp_matches({s}, '{T.E_CODE}') THEN 'e' || regexp_extract({s}, '{T.E_CODE}', 1) || lower(regexp_replace(regexp_extract({s}, '{T.E_CODE}', 2), '[\\s()\\-]', '', 'g')) ELSE {x} END"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def valid(x: str, most: int = 5, e_codes: bool = True, two: bool = False) -> str:
    n = f"length({x})"
    size = f"len({words(x)})"
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
    far = f"length(regexp_replace({x}, '[^\\p{{L}}]|[\\x00-\\x{{24F}}]', '', 'g'))"
    units = f"len(list_filter({words(x)}, lambda w: regexp_matches(w, '{T.UNIT_TOKEN}')))"
    digits = f"length(regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g'))"
    short = ", ".join(f"'{w}'" for w in T.SHORT_WORDS)
    rules = [
        f"WHEN {x} IS NULL OR {n} < 3 THEN false", f"WHEN {is_e_code(x)} THEN true" if e_codes else "", f"WHEN {size} > {most} THEN false",
        f"WHEN regexp_matches({x}, '(?i)\\b(?:{'|'.join(T.BOILERPLATE)})\\b') THEN false", f"WHEN {letters} > 0 AND {far} / {letters} > 0.25 THEN false",
        f"WHEN {units} / greatest({size}, 1) > 0.5 THEN false", f"WHEN {digits} / {n} > 0.4 THEN false",
        f"WHEN {size} <= 2 AND len(list_filter({words(x)}, lambda w: length(w) <= 2)) > 0 THEN false" if two else "",
        f"WHEN {size} = 1 AND {n} <= 5 AND lower({x}) NOT IN ({short}) THEN false",
    ]
    return f"(CASE {' '.join(r for r in rules if r)} ELSE true END)"


def additive(k: str) -> str:
    return f"regexp_matches({k}, '{T.E_CODE}')"


def noise(k: str) -> str:
    return f"regexp_matches({k}, '(?i)^(?:{'|'.join(T.NOISE_STARTS)})\\b|^contains$')"


def context(k: str) -> str:
    return f"({k} IN ({', '.join(repr(t) for t in T.CONTEXT_TERMS)}))"


def token_from(source: str, x: str, keep: str) -> str:
    """A chain of subqueries that adds `token` to `source`, from column x, keeping the columns in `keep`."""
    return f"""(SELECT {keep}, CASE WHEN {is_e_code("t2")} THEN t2 ELSE {clean_token("t2")} END AS token FROM (
        SELECT {keep}, {e_code("t1")} AS t2 FROM (SELECT {keep}, {clean(x)} AS t1 FROM {source})))"""


def tags_text(x: str) -> str:
    bare = f"list_transform(string_split({x}, ','), lambda g: {strip(f"translate(regexp_replace({strip('g')}, '^[a-z]{{2}}:', ''), '-_', '  ')")})"
    return f"CASE WHEN {blank(x)} THEN '' ELSE array_to_string(list_filter({bare}, lambda g: g <> ''), ', ') END"


def closed(x: str) -> str:
    """The text with one full stop, null if it is empty."""
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE nullif(regexp_replace({x}, '\\.+$', ''), '') || '.' END)"


def spellings(x: str) -> str:
    out = f"[{x}]"
    for a, b in T.SPELLINGS:
        out = f"list_transform([{out}], lambda vs: list_distinct(list_concat(vs, list_concat(list_transform(list_filter(vs, lambda v: contains(v, '{a}')), lambda v: replace(v, '{a}', '{b}')), list_transform(list_filter(vs, lambda v: contains(v, '{b}')), lambda v: replace(v, '{b}', '{a}'))))))[1]"
    return out


def token_set(k: str) -> str:
    return f"list_distinct({words(f"regexp_replace({k}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")})"
