import datetime
import hashlib
import random
import re

from rigspark.llm import pii
from rigspark.llm.pii import pseudonymise

KEY = "test"


def number(kind, turn, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, base_l, base_r, back=False):
    for i in reversed(range(8)) if back else range(8):
        sign = -1 if back else 1
        if i % 2 == 0:
            left = (left + sign * (number(kind, i, right) % base_l)) % base_l
        else:
            right = (right + sign * (number(kind, i, left) % base_r)) % base_r
    return left, right


def digits(kind, d, back=False):
    a = len(d) // 2
    left, right = feistel(kind, int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), back)
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def check_digit(d):
    return next(str(c) for c in range(10) if luhn(f"{d}{c}"))


def put(value, new, skip=0):
    new = iter(new)
    out, k = "", 0
    for c in value:
        if c.isdigit():
            c, k = next(new) if k >= skip else c, k + 1
        out += c
    return out


def email(value):
    local, domain = value.split("@")
    a = len(local) // 2
    left, right = local[:a], local[a:]

    def moved(half, turn, other):
        h, out = hashlib.sha256(f"{KEY}|email|{turn}|{other}".encode()).hexdigest(), ""
        for j, c in enumerate(half):
            n = int(h[j % 32 * 2 : j % 32 * 2 + 2], 16)
            low, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
            out += chr(low + (ord(c) - low + n) % size) if size else c
        return out

    for turn in range(8):
        if turn % 2 == 0:
            left = moved(left, turn, right)
        else:
            right = moved(right, turn, left)
    return f"{left}{right}@{domain}"


def date(value, order):
    at = {"ymd": (0, 5, 8), "dmy": (6, 3, 0), "mdy": (6, 0, 3)}[order]
    y, m, d = (int(value[p : p + (2 if i else 4)]) for i, p in enumerate(at))
    try:
        n = (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return value
    while True:
        left, right = feistel("date", n // 270, n % 270, 271, 270)
        n = left * 270 + right
        if n < 73049:
            break
    new = datetime.date(1900, 1, 1) + datetime.timedelta(n)
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    ends = (4, 7) if order == "ymd" else (2, 5)
    return parts[order[0]] + value[ends[0]] + parts[order[1]] + value[ends[1]] + parts[order[2]]


def one(value):
    d = re.sub(r"\D", "", value)
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, value, re.ASCII))
    if kind == "email":
        return email(value)
    if kind == "ssn":
        if re.match(r"(000|666|9)|...00|.*0000$", d):
            return value
        while True:
            d = digits("ssn", d)
            if not re.match(r"(000|666|9)|...00|.*0000$", d):
                return put(value, d)
    if kind == "phone":
        country = re.match(r"\+(\d+)", value)
        skip = 0 if not country else 1 if len(country[1]) > 3 else len(country[1])
        return put(value, digits("phone", d[skip:]), skip)
    if kind == "ipv4":
        o = [int(x) for x in value.split(".")]
        if max(o) > 255:
            return value
        left, right = feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    return date(value, kind)


def cards(run_):
    groups = re.findall(r"\d+", run_)
    pieces = re.findall(r"\d+[ \-]?", run_)

    def windows(i, usual):
        out = []
        for j in range(1, min(20, len(groups) - i) + 1):
            part = groups[i : i + j]
            d = "".join(part)
            if 13 <= len(d) <= 19 and luhn(d) and (j == 1 or [len(x) for x in part] in ([4, 4, 4, 4], [4, 6, 5])) == usual:
                out.append(j)
        return out

    out, i = "", 0
    while i < len(groups):
        j = max(windows(i, True), default=0)
        if not j:
            j = max(windows(i, False), default=0)
            if any(windows(i + o, True) for o in range(1, j)):
                j = 0
        if j:
            d = "".join(groups[i : i + j])
            new = digits("card", d[:-1])
            out += put("".join(pieces[i : i + j]), new + check_digit(new))
        else:
            out += pieces[i]
        i += max(j, 1)
    return out


def brute(text):
    """The whole text by the docstring's rules, value by value."""
    out, at = "", 0
    gap = lambda g: re.sub(pii.RUN, lambda m: cards(m[0]), g, flags=re.ASCII)
    for m in re.finditer(pii.ANY, text, re.ASCII):
        out += gap(text[at : m.start()]) + one(m[0])
        at = m.end()
    return out + gap(text[at:])


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    out = pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "n_replaced"]
    return {r.doc_id: (r.text, r.n_replaced) for r in out.collect()}


def test_cards_keep_their_format_and_check_digit(spark):
    got = run(spark, ["a 4111111111111111 b", "4111 1111 1111 1111!!", "4111111111111112", "5500-0000-0000-0004, 4111111111111111"])
    new = re.fullmatch(r"a (\d{16}) b", got[0][0])[1]
    assert new != "4111111111111111" and luhn(new) and new[:15] == digits("card", "411111111111111")
    assert re.sub(r"\D", "", got[1][0]) == new and got[1][0].count(" ") == 3 and got[1][0].endswith("!!")
    assert got[2] == ("4111111111111112", 0)
    assert got[3][0].endswith(new) and got[3][1] == 2 and re.match(r"\d{4}-\d{4}-\d{4}-\d{4}, ", got[3][0])
    assert digits("card", digits("card", "411111111111111"), back=True) == "411111111111111"


def test_cards_beside_other_numbers(spark):
    card, other = "4111111111111111", "5500000000000004"
    texts = [card, "4111 1111 1111 1111 12/25", f"42 {card}", "1234 4111 1111 1111 1111", f"{card} {other} 7", "4111-1111-1111-1111 123", "4111 1111 1111 1111 123-45-6789", "4111 1111 1111 1111 12/25/1990", "4111 1111 1111 1111 2024-02-29", "9" * 30 + " 12", "411111 1111111111", "1 2 3 " * 3000, "12 " * 5 + "\t" + "7" * 20_000]
    got = run(spark, texts)
    new, grouped = got[0][0], lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4))
    assert new != card and luhn(new)
    assert got[1] == (f"{grouped(new)} 12/25", 1) and got[2] == (f"42 {new}", 1) and got[3] == (f"1234 {grouped(new)}", 1)
    assert re.fullmatch(rf"{new} \d{{16}} 7", got[4][0]) and other not in got[4][0] and got[4][1] == 2
    assert got[5] == (grouped(new).replace(" ", "-") + " 123", 1)
    for i in (6, 7, 8):
        assert got[i][1] == 2 and got[i][0].startswith(grouped(new) + " ") and texts[i][20:] not in got[i][0]
    assert got[9] == (texts[9], 0) and got[10] == (f"{new[:6]} {new[6:]}", 1) and len(got[11][0]) == len(texts[11]) and got[12] == (texts[12], 0)


def test_dates_stay_dates(spark):
    start, texts = datetime.date(1900, 1, 1), []
    days = [datetime.date(2024, 2, 29), datetime.date(1900, 1, 1), datetime.date(2099, 12, 31), datetime.date(1999, 12, 31)]
    for d in days:
        texts += [f"on {d:%Y-%m-%d}.", f"{d:%d/%m/%Y}"]
    got = run(spark, [*texts, "2023-02-30", "31.04.2001", "12/25/1990"])
    seen = set()
    for i, d in enumerate(days):
        n = (d - start).days
        while True:
            left, right = feistel("date", n // 270, n % 270, 271, 270)
            n = left * 270 + right
            if n < 73049:
                break
        want = start + datetime.timedelta(n)
        assert got[2 * i] == (f"on {want:%Y-%m-%d}.", 1) and got[2 * i + 1] == (f"{want:%d/%m/%Y}", 1)
        seen.add(want)
    assert len(seen) == len(days)
    assert got[8] == ("2023-02-30", 0) and got[9] == ("31.04.2001", 0)
    assert datetime.datetime.strptime(got[10][0], "%m/%d/%Y") and got[10][0] != "12/25/1990"


def test_other_kinds(spark):
    text = "tel +1 (017) 555-7713, ip 233.254.104.120 bad 1.2.3.999 mail du.76Ab@mail7.example.com ssn 123-45-6789 no 000-12-3456"
    got, n = run(spark, [text, text])[0]
    m = re.fullmatch(r"tel \+1 \((\d{3})\) (\d{3})-(\d{4}), ip (\S+) bad 1\.2\.3\.999 mail ([a-z]{2})\.(\d\d[A-Z][a-z])@mail7\.example\.com ssn (\d{3}-\d{2}-\d{4}) no 000-12-3456", got)
    assert m and n == 4
    assert "".join(m.group(1, 2, 3)) == digits("phone", "0175557713")
    left, right = feistel("ipv4", 233 * 256 + 254, 104 * 256 + 120, 65536, 65536)
    assert m[4] == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert (m[5], m[6]) != ("du", "76Ab")
    want = "123456789"
    while True:
        want = digits("ssn", want)
        if not re.match(r"(000|666|9)|...00|.*0000$", want):
            break
    assert m[7].replace("-", "") == want


def test_equal_values_are_linked_and_clean_text_stays(spark):
    got = run(spark, ["x a.b1@c.de", "a.b1@c.de a.b1@c.de", None, "", "no 12 data 3.14, 1999 or 10:20", "e" * 200_000 + " 4111111111111111", "line\n4111111111111111\n\n", "4111111111111111", "a@b.c x"])
    alias = got[0][0][2:]
    assert alias != "a.b1@c.de" and got[1] == (f"{alias} {alias}", 2)
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("no 12 data 3.14, 1999 or 10:20", 0)
    assert got[5][0].endswith(got[7][0]) and got[6][0] == f"line\n{got[7][0]}\n\n"


def test_whole_texts_match_a_plain_version(spark):
    rng = random.Random(7)
    values = [lambda: f"{rng.randint(0, 10**16):016d}", lambda: "4111 1111 1111 1111", lambda: "3782-822463-10005", lambda: f"{rng.randint(1, 999)}.{rng.randint(0, 299)}.{rng.randint(0, 255)}.7", lambda: f"{rng.randint(0, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}", lambda: f"{rng.randint(1890, 2110)}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}", lambda: f"{rng.randint(0, 32):02d}/{rng.randint(0, 13):02d}/{rng.randint(1890, 2110)}", lambda: f"+{rng.randint(1, 9999)} ({rng.randint(10, 999)}) 555-{rng.randint(100, 9999)}", lambda: f"{rng.choice('aZ9.')}b{rng.randint(0, 99)}@{rng.choice('xyz')}.com", lambda: str(rng.randint(0, 10 ** rng.randint(1, 8))), lambda: "é\u0661", lambda: "word"]
    texts = ["".join(rng.choice(values)() + rng.choice([" ", " ", "-", ", ", "\n", ".", ""]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts += [r.text for r in docs.collect() if r.text]
    got, changed = run(spark, texts), 0
    for i, t in enumerate(texts):
        assert got[i][0] == brute(t), t
        changed += got[i][0] != t
    assert changed > 350


def test_no_kind_overflows_the_stack_on_long_texts(spark):
    n = 1_000_000
    texts = ["x@" + "a." * n + "com", "x@" + "a" * n, "x" * n + "@a.b", "a@b." * n, "2024-01-31-" * (n // 20), "31/01/2024/" * (n // 20), "12/25/1990 " * (n // 20), "123-45-6789 " * (n // 50), "123-45-" * (n // 20), "+1 (017) 555-7713 " * (n // 50), "+1 " * n, "1.2.3.4 " * (n // 20), "1." * n, "7" * n, "1 2-3 " * (n // 50), "4111 1111 1111 1111 " * (n // 20), "(" * n, "-" * n]
    got = run(spark, texts)
    assert got[0][0][1:] == texts[0][1:] and got[0][1] == 1
    for i in (1, 8, 10, 12, 13, 16, 17):
        assert got[i] == (texts[i], 0), texts[i][:30]
    for i, unit in ((4, "2024-01-31-"), (5, "31/01/2024/"), (6, "12/25/1990 "), (7, "123-45-6789 "), (9, "+1 (017) 555-7713 "), (11, "1.2.3.4 "), (15, "4111 1111 1111 1111 ")):
        times = len(texts[i]) // len(unit)
        assert got[i] == (brute(unit) * times, times), unit
    for i in (2, 3, 14):
        assert len(got[i][0]) == len(texts[i]) and got[i][1]


def test_clashing_names_and_no_hint(spark):
    df = spark.createDataFrame([(1, "tel 4111111111111111", "a", 2), (2, "no number", "b", 3)], "`__found` long, text string, `__HOT` string, `g.x` long")
    out = pseudonymise(df, KEY)
    assert out.columns == ["__found", "text", "__HOT", "g.x", "n_replaced"]
    assert {tuple(r)[0]: tuple(r)[2:] for r in out.collect()} == {1: ("a", 2, 1), 2: ("b", 3, 0)}


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before, after = {r.doc_id: r.text for r in docs.collect()}, pseudonymise(docs, KEY).collect()
    assert len(after) == len(before) and any(r.n_replaced for r in after)
    for r in after:
        old = before[r.doc_id]
        cards = [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", old) if luhn(c)]
        assert not any(c in r.text for c in cards)
        assert not any(e in r.text for e in re.findall(r"[\w.]+\d@mail\d\.example\.com", old))
        assert len(r.text) == len(old) or re.search(r"\d+\.\d+\.\d+\.\d+", old)
        if not r.n_replaced:
            assert r.text == old
    plan = pseudonymise(docs, KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
