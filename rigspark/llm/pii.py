"""Format-preserving pseudonyms for personal data, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_names

#: What each kind of value looks like (Java regular expressions).  Groups that repeat
#: without a bound are possessive: Java matches these in a loop, others by recursion, which ends
#: the executor with a stack overflow on a long text.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
YMD = r"(?<!\d)(?:19|20)\d\d[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])(?!\d)"
DMY = r"(?<!\d)(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)\d\d(?!\d)"
MDY = r"(?<!\d)(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/(?:19|20)\d\d(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"\+\d{1,3}[ \-.]?\(?\d{2,4}\)?[ \-.]?\d{3}[ \-.]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)(?!\.\d)"
#: A whole run of digit groups of 13 digits or more; cards are looked for inside it.
RUN = r"(?<!\d)\d(?:[ \-]?+\d){12,}+"
#: What every text with a value of any kind has: an at sign, or two digits with little between.
HINT = r"@|\d[ \-./()]{0,2}\d"
#: Groups in which cards are written, beside a single one.
CARD_GROUPS = ("4-4-4-4", "4-6-5")
KINDS = {"email": EMAIL, "ymd": YMD, "dmy": DMY, "mdy": MDY, "ssn": SSN, "phone": PHONE, "ipv4": IPV4}
ANY = "|".join(KINDS.values())

ROUNDS = 8
#: Days from the first of 1900 to the last of 2099, and the product of the Feistel halves above it.
FIRST_DAY, DAYS, DAY_L, DAY_R = "1900-01-01", 73049, 271, 270


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, kind: str, turn: str, half: str) -> str:
    """A keyed 60-bit number."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_q(key)}, {_q(kind)}, cast({turn} as string), cast({half} as string)), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, left: str, right: str, base_l: str, base_r: str) -> str:
    """SQL of a struct (l, r): the keyed permutation of pairs below ``base_l`` and ``base_r``.

    Even rounds add a hash of the right half to the left one, odd rounds the reverse, each modulo
    its base; every round can be undone, so no two values share a pseudonym.
    """
    even = f"named_struct('l', pmod(a.l + {_hash(key, kind, 'i', 'a.r')} % ({base_l}), {base_l}), 'r', a.r)"
    odd = f"named_struct('l', a.l, 'r', pmod(a.r + {_hash(key, kind, 'i', 'a.l')} % ({base_r}), {base_r}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (a, i) -> if(i % 2 = 0, {even}, {odd}))"


def digits_permuted(key: str, kind: str, digits: str) -> str:
    """SQL of the digit string's pseudonym, a digit string of the same length (2 to 36)."""
    half = f"cast(length({digits}) div 2 as int)"
    base_l, base_r = f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, length({digits}) - {half}) as bigint)"
    pair = feistel(key, kind, f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", base_l, base_r)
    return f"element_at(transform(array({pair}), p -> concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), length({digits}) - {half}, '0'))), 1)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn_sum(digits: str, first: int) -> str:
    """SQL of the Luhn sum; ``first``: the weight of the last digit."""
    # z holds twice each digit, less 9 where that has two digits; its digits count at every second place.
    total = f"aggregate(sequence(1, length(y)), 0, (s, i) -> s + cast(substr(if(i % 2 = {0 if first == 1 else 1}, z, y), i, 1) as int))"
    return _let(f"reverse({digits})", "y", _let("translate(y, '0123456789', '0246813579')", "z", total))


def filled(value: str, digits: str, skip: str = "0") -> str:
    """SQL: ``value`` with its digits, after the first ``skip``, replaced by those of ``digits``."""
    step = f"if(c rlike '^[0-9]$', named_struct('s', concat(a.s, if(a.k < {skip}, c, substr({digits}, a.k - {skip} + 1, 1))), 'k', a.k + 1), named_struct('s', concat(a.s, c), 'k', a.k))"
    return f"aggregate(split({value}, ''), named_struct('s', '', 'k', 0), (a, c) -> {step}, a -> a.s)"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: A digit group with what parts it from the next one, and up to 20 digits from where it begins.
GROUP, AHEAD = r"\d++[ \-]?", r"(?=(\d(?:[ \-]?\d){0,19}))\d++[ \-]?"
#: Marks of a card of 1 to 19 groups, and of a group at which none begins; a run holds no letters.
MARKS, NO_CARD = "abcdefghijklmnopqrs", "z"
MARKED = "|".join(f"{m}[^a-z]++(?:[a-z][^a-z]++){{{n}}}" for n, m in enumerate(MARKS)) + f"|(?:{NO_CARD}[^a-z]++)++"


def _cards(key: str, r: str) -> str:
    """SQL of a struct (s, n): the run with its cards replaced, and how many changed.

    Candidates are all windows of 13 to 19 digits that begin and end at group bounds and have a
    right check digit.  The run is read from the left: at each group the longest candidate in the
    usual groups is taken, else the longest other one unless a usual one begins inside it.
    Each group gets a mark that tells how many groups the candidate there spans, and one regular
    expression then cuts the run at the marks, so the work is linear in the run's length.
    """
    # The groups of what lies ahead; of 20 digits the last group is cut off or makes the window too long.
    groups = _let("split(a, '[ -]')", "g", "if(length(array_join(g, '')) < 20, g, slice(g, 1, size(g) - 1))")
    part = "slice(g, 1, j)"
    usual = f"j = 1 or array_join(transform({part}, x -> cast(length(x) as string)), '-') in ({', '.join(map(_q, CARD_GROUPS))})"
    windows = f"transform(filter(transform(sequence(1, size(g)), j -> named_struct('k', {usual}, 'j', j, 'd', array_join({part}, ''))), w -> length(w.d) between 13 and 19 and {luhn_sum('w.d', 1)} % 10 = 0), w -> named_struct('k', w.k, 'j', w.j))"
    best = "coalesce(get(filter(v, w -> w.k), cast(size(filter(v, w -> w.k)) - 1 as int)), get(v, size(v) - 1))"
    # Of each group: its best candidate (k: in the usual groups, j: how many groups), null without one.
    found = f"transform(regexp_extract_all({r}, {_q(AHEAD)}, 1), a -> {_let(groups, 'g', f'if(size(g) = 0, null, {_let(windows, chr(118), best)})')})"
    yields = "not c.k and c.j > 1 and exists(sequence(1, c.j - 1), o -> coalesce(get(f, i + o).k, false))"
    mark = f"if(c is null or {yields}, {_q(NO_CARD)}, substr({_q(MARKS)}, c.j, 1))"
    marked = f"array_join(zip_with(transform(f, (c, i) -> {mark}), regexp_extract_all({r}, {_q(GROUP)}, 0), (m, x) -> concat(m, x)), '')"
    body = _let(digits_permuted(key, "card", "substr(d, 1, length(d) - 1)"), "e", f"concat(e, cast(pmod(10 - {luhn_sum('e', 2)} % 10, 10) as string))")
    card = _let(_digits("p"), "d", _let(body, "b", f"named_struct('s', {filled('p', 'b')}, 'n', if(b <> d, 1, 0))"))
    piece = f"if(x like {_q(NO_CARD + '%')}, named_struct('s', regexp_replace(x, '[a-z]', ''), 'n', 0), {_let('regexp_replace(x, ' + _q('[a-z]') + ', ' + _q('') + ')', 'p', card)})"
    pieces = f"transform(regexp_extract_all({_let(found, 'f', marked)}, {_q(MARKED)}, 0), x -> {piece})"
    return _let(pieces, "u", "named_struct('s', array_join(transform(u, y -> y.s), ''), 'n', aggregate(u, 0, (a, y) -> a + y.n))")


def _ssn(key: str, m: str) -> str:
    good = lambda d: f"not ({d} rlike '^(000|666|9)|^...00|0000$')"
    step = digits_permuted(key, "ssn", "w")
    # An eighth of the numbers is not valid: the permutation goes on until it meets a valid one.
    walked = f"aggregate(sequence(1, 64), {_let('d', 'w', step)}, (w, t) -> if({good('w')}, w, {step}))"
    return _let(_digits(m), "d", f"if({good('d')}, {filled(m, walked)}, {m})")


def _phone(key: str, m: str) -> str:
    skip = f"if({m} like '+%', length(regexp_extract({m}, '^.([0-9]+)', 1)), 0)"
    # A country code without a gap after it is taken to be one digit.
    skip = f"if({m} rlike '^.[0-9]{{4,}}', 1, {skip})"
    return _let(skip, "k", _let(f"substr({_digits(m)}, k + 1)", "d", f"if(length(d) < 2, {m}, {filled(m, digits_permuted(key, 'phone', 'd'), 'k')})"))


def _ipv4(key: str, m: str) -> str:
    octet = lambda i: f"cast(o[{i}] as int)"
    pair = feistel(key, "ipv4", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
    text = _let(pair, "p", "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)")
    return _let(f"split({m}, '[.]')", "o", f"if(exists(o, x -> cast(x as int) > 255), {m}, {text})")


def _date(key: str, m: str, order: str) -> str:
    at = {"ymd": (1, 6, 9), "dmy": (7, 4, 1), "mdy": (7, 1, 4)}[order]
    year, month, day = (f"substr({m}, {a}, {4 if i == 0 else 2})" for i, a in enumerate(at))
    step = _let(feistel(key, "date", f"n div {DAY_R}", f"n % {DAY_R}", str(DAY_L), str(DAY_R)), "p", f"p.l * {DAY_R} + p.r")
    # The halves allow 121 numbers beyond the last day, so the walk ends within 122 steps.
    walked = f"aggregate(sequence(1, {DAY_L * DAY_R - DAYS + 1}), {_let('cast(n as bigint)', 'n', step)}, (n, t) -> if(n < {DAYS}, n, {step}))"
    s1, s2 = (f"substr({m}, {a}, 1)" for a in ((5, 8) if order == "ymd" else (3, 6)))
    part = {"y": "date_format(v, 'yyyy')", "m": "date_format(v, 'MM')", "d": "date_format(v, 'dd')"}
    text = f"concat({part[order[0]]}, {s1}, {part[order[1]]}, {s2}, {part[order[2]]})"
    new = _let(f"cast(datediff(d, date'{FIRST_DAY}') as bigint)", "n", _let(f"date_add(date'{FIRST_DAY}', cast({walked} as int))", "v", text))
    return _let(f"try_cast(concat_ws('-', {year}, {month}, {day}) as date)", "d", f"if(d is null, {m}, {new})")


def _email(key: str, m: str) -> str:
    """Letters stay letters of their case, digits stay digits; the domain is kept."""
    def shifted(half: str, other: str) -> str:
        add = f"cast(conv(substr(h, (j - 1) % 32 * 2 + 1, 2), 16, 10) as int)"
        c = f"substr({half}, j, 1)"
        move = lambda low, n: f"char({low} + (ascii({c}) - {low} + {add}) % {n})"
        one = f"case when {c} rlike '[0-9]' then {move(48, 10)} when {c} rlike '[a-z]' then {move(97, 26)} when {c} rlike '[A-Z]' then {move(65, 26)} else {c} end"
        mixed = f"sha2(concat_ws('|', {_q(key)}, 'email', cast(i as string), {other}), 256)"
        return f"if(length({half}) = 0, '', {_let(mixed, 'h', f'array_join(transform(sequence(1, length({half})), j -> {one}), {_q(str())})')})"

    start = "named_struct('l', substr(u, 1, cast(length(u) div 2 as int)), 'r', substr(u, cast(length(u) div 2 as int) + 1))"
    turn = f"if(i % 2 = 0, named_struct('l', {shifted('a.l', 'a.r')}, 'r', a.r), named_struct('l', a.l, 'r', {shifted('a.r', 'a.l')}))"
    local = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (a, i) -> {turn}, a -> concat(a.l, a.r))"
    return _let(f"substring_index({m}, '@', 1)", "u", f"concat({local}, '@', substring_index({m}, '@', -1))")


def pseudonym(key: str, value: str) -> str:
    """SQL of the pseudonym of one found value; a value that is not valid stays."""
    new = {"ssn": _ssn(key, value), "phone": _phone(key, value), "ipv4": _ipv4(key, value)}
    new |= {k: _date(key, value, k) for k in ("ymd", "dmy", "mdy")}
    whole = {k: f"{value} rlike {_q('^(?:' + KINDS[k] + ')$')}" for k in new}
    # Only an e-mail address has an at sign; the others are short.
    return f"case when {value} like '%@%' then {_email(key, value)} " + " ".join(f"when {whole[k]} then {new[k]}" for k in KINDS if k in new) + f" else {value} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input with personal data in ``text_col`` replaced by pseudonyms, and ``n_replaced``.

    Found are e-mail addresses, dates (year first, day first, or month first where the day is
    above 12; 1900 to 2099), social security and phone numbers, IPv4 addresses and payment card
    numbers.  Values are validated: a card number by its check digit, an address by its octets, a
    date by the calendar, a security number by its ranges; what fails stays as it is.  Cards are
    looked for between the other values, also beside further digit groups (:func:`_cards`).  Each value
    is permuted within its format by a Feistel network under ``key``: digits keep their number and
    punctuation, a card number gets its right check digit, a phone number keeps its country code,
    an e-mail address its domain.  Equal values have equal pseudonyms in all documents, and
    different ones of a kind and length have different ones.

    A null text stays null with ``n_replaced`` 0, an empty one empty; text around the values is not
    touched.  Texts of any length are read whole, in time linear in their length.  Rows are
    independent of each other and repeated rows have equal results, so there is no shuffle;
    ``n_replaced`` of the input is replaced, all other columns of any name stay.
    """
    text, names = F.col(f"`{text_col}`"), fresh_names(docs, "hot", "found", "gaps", "new")
    hot, found, gaps, new = (F.col(n) for n in names.values())
    kept = [c for c in docs.columns if c != "n_replaced"]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text.rlike(HINT).alias(names["hot"]))
    rows = rows.withColumn(names["found"], F.when(hot, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).withColumn(names["gaps"], F.when(hot, F.split(text, ANY, -1)))
    # What is between the values, cut at its digit runs: (text, n) of each gap.
    runs = f"transform(regexp_extract_all(g, {_q(RUN)}, 0), r -> {_cards(key, 'r')})"
    whole = f"array_join(zip_with(split(g, {_q(RUN)}, -1), c, (x, y) -> concat(x, coalesce(y.s, ''))), '')"
    total = "aggregate(c, 0, (a, y) -> a + y.n)"
    gap = f"if(g rlike {_q(RUN)}, {_let(runs, 'c', f"named_struct('s', {whole}, 'n', {total})")}, named_struct('s', g, 'n', 0))"
    rows = rows.withColumn(names["new"], F.expr(f"transform({names['found']}, m -> {pseudonym(key, 'm')})")).withColumn(names["gaps"], F.expr(f"transform({names['gaps']}, g -> {gap})"))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g["s"], F.coalesce(n, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)) + F.aggregate(gaps, F.lit(0), lambda a, g: a + g["n"])
    out = [F.when(changed > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    return rows.select(*out, F.greatest(F.coalesce(changed, F.lit(0)), F.lit(0)).cast("long").alias("n_replaced"))
