"""Pseudonyms against a plain Python network, validity, links, and that nothing else changes."""

import datetime
import hashlib
import re

import pytest

from vacancyledger.llm import pii

KEY = "test-key"


def digest(tweak, turn, other):
    return hashlib.sha256(f"{KEY}:{tweak}:{turn}:{other}".encode()).hexdigest()


def permuted_pair(x, y, a, b, tweak):
    for n in range(pii.ROUNDS):
        shift = int(digest(tweak, n, x if n % 2 else y)[:15], 16)
        if n % 2 == 0:
            x = (x + shift) % a
        else:
            y = (y + shift) % b
    return x, y


def permuted_text(value, tweak):
    def shifted(text, hexes):
        out = []
        for i, c in enumerate(text, 1):
            by = int(hexes[i % 31 * 2 : i % 31 * 2 + 2], 16)
            for first, size in ((48, 10), (97, 26), (65, 26), (192, 64)):
                if first <= ord(c) < first + size:
                    c = chr((ord(c) - first + by) % size + first)
                    break
            out.append(c)
        return "".join(out)

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for n in range(pii.ROUNDS):
        left, right = right, shifted(left, digest(tweak, n, right))
    return left + right


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.pseudonymised(df, key).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.found for r in rows]


def test_values_follow_the_network(spark):
    (mail, ip, date, ssn, phone), found = run(
        spark, ["x un.d34@mail7.example.com!", "97.51.17.173", "on 1990-03-12", "123-45-6789", "+1 (017) 555-7713"]
    )
    name = permuted_text("und34", "email")
    assert mail == f"x {name[:2]}.{name[2:]}@mail7.example.com!"
    x, y = permuted_pair(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ip")
    assert ip == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    days = (datetime.date(1990, 3, 12) - datetime.date(1900, 1, 1)).days
    x, y = permuted_pair(days // 397, days % 397, 92, 397, "date")
    assert date == f"on {datetime.date(1900, 1, 1) + datetime.timedelta(x * 397 + y)}"
    x, y = permuted_pair(122 * 99 + 44, 6788, 898 * 99, 9999, "ssn")
    area = x // 99 + 1
    assert ssn == f"{area + (area >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    digits = permuted_text("0175557713", "phone")
    assert phone == f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    assert found == [["email"], ["ip"], ["date"], ["ssn"], ["phone"]]


def test_cards_stay_valid_and_linked(spark):
    texts = ["4111111111111111", "4111 1111 1111 1111, 4111-1111-1111-1111", "9807915762804490", "5500005555555559 4111111111111111"]
    got, found = run(spark, texts)
    card = got[0]
    assert card != texts[0] and luhn(card) == 0
    assert card[:15] == permuted_text(texts[0][:15], "card")
    groups = [card[i : i + 4] for i in range(0, 16, 4)]
    assert got[1] == f"{' '.join(groups)}, {'-'.join(groups)}"
    assert got[2] == texts[2] and found[2] == []
    assert got[3].split()[1] == card and luhn(got[3].split()[0]) == 0


def test_ibans_stay_valid(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001"]
    got, found = run(spark, texts)
    assert found == [["iban"], ["iban"], []] and got[2] == texts[2]
    for before, after in zip(texts[:2], got[:2], strict=True):
        plain = after.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        assert [c.isdigit() for c in before[4:]] == [c.isdigit() for c in after[4:]] and after[:2] == before[:2]


@pytest.mark.parametrize(
    "iban",
    ["BE68539007547034", "BE68 5390 0754 7034", "ES9121000418450200051332", "AT611904300234573201", "SE4550000000058398257466",
     "PL61109010140000071219812874", "CZ6508000000192000145399", "SK3112000000198742637541", "NO9386011117947", "DE89370400440532013000"],
)
def test_ibans_end_at_their_countrys_length(spark, iban):
    tails = ["", " EUR", " BIC GEBABEBB", " A1", ", 5", " 4111111111111111"]
    got, found = run(spark, [iban + t for t in tails])
    assert found == [["iban"]] * 5 + [["iban", "card"]]
    assert got[0] != iban and [g.removesuffix(t) for g, t in zip(got[:5], tails[:5], strict=True)] == [got[0]] * 5
    plain = got[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_dates_of_timestamps(spark):
    texts = ["2024-01-05", "2024-01-05T10:00", "at 2024-01-05T10:00:00Z.", "2024-01-05t10:00", "2024-01-05Tx", "2024-01-05T", "2024-01-05a"]
    got, found = run(spark, texts)
    assert found == [["date"]] * 4 + [[]] * 3 and got[4:] == texts[4:] and got[0] != texts[0]
    assert got[1:4] == [f"{got[0]}T10:00", f"at {got[0]}T10:00:00Z.", f"{got[0]}t10:00"]


def test_names_of_other_scripts(spark):
    texts = [n + "@mail.example.com" for n in ("иван.петров", "αλέξανδρος", "李小龙", "Łukasz", "ª", "𐐨𐐩x", "Ά", "иван.петроб")]
    got, found = run(spark, texts)
    assert found == [["email"]] * len(texts) and len(set(got)) == len(got)
    for before, after in zip(texts, got, strict=True):
        old, new = before.split("@")[0], after.split("@")[0]
        assert len(old) == len(new) and [c == "." for c in old] == [c == "." for c in new]
        assert not any(a == b for a, b in zip(old, new, strict=True) if ord(a) > 127) and all(c == "." or c.isalnum() for c in new)
    again, found = run(spark, got)
    assert found == [["email"]] * len(texts)


def test_wide_letters_are_permuted(spark):
    from pyspark.sql import functions as F

    letters = [chr(c) for c in range(0x370, 0x530) if chr(c).isalnum()]
    df = spark.createDataFrame([(c,) for c in letters], "v string")
    got = [r[0] for r in df.select(pii.permute_text(F.col("v"), "t", KEY, wide=True)).collect()]
    assert len(set(got)) == len(letters) and all(c.isalnum() for c in got) and not any(a == b for a, b in zip(letters, got, strict=True))


def test_telephone_forms(spark):
    texts = ["555-123-4567", "555.123.4567", "call 555 123 4567.", "1.555.123.4567", "1.555.123.4567.8", "5555.123.4567", "555 123 45678"]
    got, found = run(spark, texts)
    assert found == [["phone"]] * 4 + [[]] * 3 and got[4:] == texts[4:]
    digits = got[0].split("-")
    assert got[1] == ".".join(digits) and got[2] == f"call {' '.join(digits)}."
    assert re.fullmatch(r"\d\.\d{3}\.\d{3}\.\d{4}", got[3])


def test_dates_are_a_permutation_of_their_century(spark):
    """All days of two centuries: valid, distinct, in the same century, written alike."""
    for first, last in ((1900, 1999), (2000, 2099)):
        start, end = datetime.date(first, 1, 1), datetime.date(last, 12, 31)
        days = [start + datetime.timedelta(n) for n in range((end - start).days + 1)]
        got, _ = run(spark, [str(d) for d in days])
        assert sorted(got) == [str(d) for d in days]


def test_dates_link_over_formats(spark):
    got, found = run(spark, ["1990-03-12", "12.03.1990", "03/12/1990", "31/12/1999", "12/31/1999", "1.2.1990", "2023-02-30", "32.01.2000", "2001-1-1"])
    y, m, d = got[0].split("-")
    assert got[1:3] == [f"{d}.{m}.{y}", f"{m}/{d}/{y}"]
    a, b, c = got[3].split("/")
    assert got[4] == f"{b}/{a}/{c}"
    assert got[6:] == ["2023-02-30", "32.01.2000", "2001-1-1"] and found[6:] == [[], [], []]


def test_permutation_of_short_texts(spark):
    values = [f"{i:03d}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(pii.permute_text(F.col("v"), "t", KEY)).collect()]
    assert sorted(got) == values
    assert got == [permuted_text(v, "t") for v in values]


@pytest.mark.parametrize(
    "text",
    ["version 4.0. and 2.0", "999.1.1.1", "12 345 678", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "a @ b", "x@y", "1.2.3.4.5", "000-12-3456", "user@", "+1", "12345678901234567890"],
)
def test_what_is_not_personal_stays(spark, text):
    assert run(spark, [text]) == ([text], [[]])


def test_awkward_rows(awkward, nothing, spark, documents):
    got = pii.pseudonymised(awkward)
    assert "found_input" in got.columns and got.count() == awkward.count()
    assert sorted(map(str, got.select(awkward.columns[:5]).collect())) == sorted(map(str, awkward.select(awkward.columns[:5]).collect()))
    assert pii.pseudonymised(nothing, found=None).columns == nothing.columns
    long = documents([(1, "word " * 50_000 + "mail me.too@mail7.example.com 10.0.0.1")])
    row = pii.pseudonymised(long).first()
    assert row.found == ["email", "ip"] and row.n_chars == len(row.text)
    assert run(spark, ["10.0.0.1"], "other")[0] != run(spark, ["10.0.0.1"])[0]


def test_only_values_change(sample):
    before = {r.doc_id: r.text for r in sample("documents").collect()}
    for r in pii.pseudonymised(sample("documents")).collect():
        if not r.found:
            assert r.text == before[r.doc_id]
        else:
            assert re.sub(r"\w", "", r.text) == re.sub(r"\w", "", before[r.doc_id])


def test_plan_has_no_python(sample):
    plan = pii.pseudonymised(sample("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
