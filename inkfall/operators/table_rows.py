"""What rows of tables say, as column expressions: templates, numbers, metadata.

Tables come as row_tables.py reads them, cells filled and references spelled out: `rows` are values by
header, where of headers that repeat the last cell counts. Each row of a table is a row of the DataFrame
before anything is told of it, so a table takes time in proportion to its rows; nothing is shuffled.
"""

from __future__ import annotations

from inkfall.functions.text import wide_space
from inkfall.operators.folds import _bound, _strip, quoted

TABLES = "array<struct<index: int, context: string, headers: array<string>, first: int, rows: array<array<string>>>>"

# Forms of numbers, as the JVM reads them.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
NUMBER_WITH_UNIT = wide_space(r"^(-?[0-9]+(?:\.[0-9]+)?)\s*[a-zA-Z一-鿿]+$")


def _digits(word: str) -> str:
    """Full-width digits as ASCII ones."""
    return f"translate({word}, '０１２３４５６７８９', '0123456789')"


def _told(text: str) -> str:
    """A string as JSON."""
    escaped = f"substring(to_json(array({text})), 2, length(to_json(array({text}))) - 2)"
    return f"if({text} rlike {quoted(r'["\\\x00-\x1f]')}, {escaped}, concat('\"', {text}, '\"'))"


def names_rows(header: str, words: tuple[str, ...]) -> str:
    """Whether a header says that its column names the rows."""
    plain = f"replace(replace(lower({header}), ' ', ''), '/', '')"
    return f"exists(array({', '.join(map(quoted, words))}), k -> contains({plain}, k))"


def sentence(context: str, headers: str, values: str, by_key: str) -> str:
    """What a row says: its values by header, in the context of its table, about its key where it has one."""
    told = f"array_join(filter(transform({headers}, (h, i) -> if(get(v, i) = '' or {by_key} and i = 0, '', concat(h, '为', if(endswith(get(v, i), '。'), left(get(v, i), length(get(v, i)) - 1), get(v, i))))), z -> z <> ''), '，')"
    key = f"if({by_key}, coalesce(get(v, 0), ''), '')"
    cases = (
        f"case when key <> '' and told <> '' then concat(if({context} <> '', concat('在', {context}, '中，'), ''), '关于【', key, '】的记录显示：', told, '。')"
        f" when key <> '' then concat(if({context} <> '', concat('在', {context}, '中中，'), ''), '存在记录【', key, '】。')"
        f" when told <> '' then concat(if({context} <> '', concat({context}, '中，'), ''), told, '。') else '' end"
    )
    return _bound(f"transform({values}, z -> {_strip('z')})", "v", _bound(told, "told", _bound(key, "key", cases)))


def _number(value: str) -> str:
    """A value as a JSON number, or null: whole ones without a point, others as doubles; with a unit behind it as a double."""
    whole = "if(regexp_replace(w, '^(-?)0*', '') = '', '0', regexp_replace(w, '^(-?)0+(?=[0-9])', '$1'))"
    real = f"case when instr(w, '.') > 0 then cast(cast(w as double) as string) when instr(lower(w), 'e') = 0 then {whole} end"
    unit = f"cast(try_cast(nullif(regexp_extract(w, {quoted(NUMBER_WITH_UNIT)}, 1), '') as double) as string)"
    return _bound(_digits(_strip(value)), "w", f"if(w rlike {quoted(NUMBER)}, {real}, {unit})")


def columns(headers: str) -> str:
    """Places of the headers, each name once, and the names as JSON: what the rows of a table share."""
    once = f"filter(sequence(0, size({headers}) - 1), c -> array_position({headers}, get({headers}, c)) = c + 1)"
    return f"transform({once}, c -> struct(c as place, concat({_told(f'get({headers}, c)')}, ': ') as name))"


def metadata(context: str, index: str, columns: str, values: str, row: str) -> str:
    """Title and places, the values by header, and the numbers among them, as JSON."""
    value = f"get({values}, c.place)"
    raw = f"array_join(transform({columns}, c -> concat(c.name, {_told(value)})), ', ')"
    numbers = f"array_join(transform(filter({columns}, c -> {value} rlike '[0-9０-９]'), c -> concat(c.name, {_number(value)})), ', ')"
    return f"concat('{{\"table_title\": ', {_told(context)}, ', \"table_index\": ', {index}, ', \"row_index\": ', {row}, ', \"raw_data\": {{', {raw}, '}}, \"numeric_fields\": {{', {numbers}, '}}}}')"
