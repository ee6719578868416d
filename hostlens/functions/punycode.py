"""Internationalised labels in both spellings: Bootstring (RFC 3492) as column expressions.

Only labels that need it are walked, one symbol at a time by `aggregate`; names in plain ASCII pass a
pattern test and nothing else. Upper case and normal forms are the caller's business.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of Bootstring for domain names.
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
PREFIX = "xn--"

_OTHER = r"r'[^\x00-\x7F]'"
_MOST = 1 << 40  # beyond any delta of a valid label; keeps products of odd input from overflowing


def _points(text: str) -> str:
    return f"transform(sequence(1, length({text})), i -> CAST(ascii(substring({text}, i, 1)) AS BIGINT))"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _clamped(k: str, bias: str) -> str:
    return f"greatest({T_MIN}L, least({T_MAX}L, {k} - {bias}))"


def _adapted(delta: str, points: str, first: str) -> str:
    scaled = f"{delta} div IF({first}, {DAMP}L, 2L)"
    top = (BASE - T_MIN) * T_MAX // 2
    shrunk = (
        f"aggregate(sequence(1, 10), named_struct('d', e + e div ({points}), 'k', 0L), "
        f"(a, x) -> IF(a.d > {top}, named_struct('d', a.d div {BASE - T_MIN}L, 'k', a.k + {BASE}L), a), "
        f"a -> a.k + {BASE - T_MIN + 1}L * a.d div (a.d + {SKEW}L))"
    )
    return _let("e", scaled, shrunk)


def _digits(delta: str, bias: str) -> str:
    """A number as digits of variable length."""
    t = _clamped("k", bias)

    def digit(x: str) -> str:
        return f"substring('{DIGITS}', CAST({x} AS INT) + 1, 1)"

    return (
        f"aggregate(sequence({BASE}L, {BASE * 12}L, {BASE}L), named_struct('q', {delta}, 'o', '', 'go', true), "
        f"(v, k) -> CASE WHEN NOT v.go THEN v "
        f"WHEN v.q < {t} THEN named_struct('q', v.q, 'o', v.o || {digit('v.q')}, 'go', false) "
        f"ELSE named_struct('q', (v.q - {t}) div ({BASE}L - {t}), "
        f"'o', v.o || {digit(f'{t} + (v.q - {t}) % ({BASE}L - {t})')}, 'go', true) END, v -> v.o)"
    )


def _encoded(label: str) -> str:
    """SQL: the ASCII form of a label that has other symbols."""
    symbol = (
        "(a, c) -> CASE WHEN c < m THEN named_struct('delta', a.delta + 1L, 'bias', a.bias, 'h', a.h, 'out', a.out) "
        f"WHEN c = m THEN named_struct('delta', 0L, 'bias', {_adapted('a.delta', 'a.h + 1L', 'a.h = s.b')}, "
        f"'h', a.h + 1L, 'out', a.out || {_digits('a.delta', 'a.bias')}) ELSE a END"
    )
    step = (
        "(s, m) -> aggregate(p, named_struct('delta', s.delta + (m - s.n) * (s.h + 1L), 'bias', s.bias, 'h', s.h, 'out', s.out), "
        f"{symbol}, a -> named_struct('delta', a.delta + 1L, 'n', m + 1L, 'bias', a.bias, 'h', a.h, 'b', s.b, 'out', a.out))"
    )
    plain = f"regexp_replace({label}, {_OTHER}, '')"
    n = "CAST(size(filter(p, c -> c < 128)) AS BIGINT)"
    zero = (
        f"named_struct('delta', 0L, 'n', {FIRST_POINT}L, 'bias', {FIRST_BIAS}L, 'h', {n}, 'b', {n}, "
        f"'out', {plain} || IF({n} > 0, '-', ''))"
    )
    walk = f"aggregate(array_sort(array_distinct(filter(p, c -> c >= 128))), {zero}, {step}, s -> s.out)"
    return f"'{PREFIX}' || " + _let("p", _points(label), walk)


def _decoded(label: str) -> str:
    """SQL: the text that an ASCII form stands for, or the label itself where it is not well formed."""
    body = f"substring({label}, {len(PREFIX) + 1})"
    plain, digits = (f"regexp_extract({body}, r'^(?:(.*)-)?([^-]*)$', {i})" for i in (1, 2))
    t = _clamped("s.k", "s.bias")
    done = (
        "named_struct('i', at % many + 1L, 'old', at % many + 1L, 'w', 1L, "
        f"'k', {BASE}L, 'n', s.n + at div many, 'bias', {_adapted('(at - s.old)', 'many', 's.old = 0')}, "
        "'out', array_insert(s.out, CAST(at % many AS INT) + 1, s.n + at div many), 'whole', true, 'ok', s.ok)"
    )
    more = (
        f"named_struct('i', at, 'old', s.old, 'w', s.w * ({BASE}L - {t}), 'k', s.k + {BASE}L, "
        f"'n', s.n, 'bias', s.bias, 'out', s.out, 'whole', false, 'ok', s.w < {_MOST}L AND at < {_MOST}L)"
    )
    bound = _let("at", "s.i + d * s.w", _let("many", "CAST(size(s.out) + 1 AS BIGINT)", f"IF(d < {t}, {done}, {more})"))
    zero = (
        f"named_struct('i', 0L, 'old', 0L, 'w', 1L, 'k', {BASE}L, 'n', {FIRST_POINT}L, 'bias', {FIRST_BIAS}L, "
        f"'out', IF({plain} = '', CAST(array() AS ARRAY<BIGINT>), {_points(plain)}), 'whole', true, 'ok', true)"
    )
    numbers = f"transform(sequence(1, length({digits})), i -> CAST(instr('{DIGITS}', substring({digits}, i, 1)) - 1 AS BIGINT))"
    walk = f"aggregate({numbers}, {zero}, (s, d) -> CASE WHEN NOT s.ok OR d < 0 THEN named_struct(" + ", ".join(
        f"'{c}', {'false' if c == 'ok' else 's.' + c}" for c in ("i", "old", "w", "k", "n", "bias", "out", "whole", "ok")
    ) + f") ELSE {bound} END)"
    symbol = "decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')"
    valid = "r.ok AND r.whole AND forall(r.out, c -> c < 55296 OR c BETWEEN 57344 AND 1114111)"
    text = f"IF({valid}, array_join(transform(r.out, c -> {symbol}), ''), {label})"
    return f"CASE WHEN {digits} = '' THEN {label} ELSE {_let('r', walk, text)} END"


def _by_label(name: str, wanted: str, change: str) -> Column:
    labels = f"transform(split({name}, '[.]'), l -> CASE WHEN {wanted} THEN {change} ELSE l END)"
    return F.expr(f"array_join({labels}, '.')")


def to_ascii(name: str) -> Column:
    """The name of a column with every label in ASCII; NULL stays NULL."""
    column = F.col(name)
    return F.when(column.rlike(r"[^\x00-\x7F]"), _by_label(f"`{name}`", f"l RLIKE {_OTHER}", _encoded("l"))).otherwise(column)


def to_unicode(name: str) -> Column:
    """The name of a column with every `xn--` label written out; labels that stand for nothing stay."""
    column = F.col(name)
    change = _by_label(f"`{name}`", f"startswith(l, '{PREFIX}') AND NOT l RLIKE {_OTHER}", _decoded("l"))
    return F.when(column.contains(PREFIX), change).otherwise(column)
