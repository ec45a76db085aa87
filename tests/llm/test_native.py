"""Mixing, line dedup and pseudonyms: SQL, brute force, and plans without Python."""

from __future__ import annotations

import datetime
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sluicegate.llm import line_dedup, mixing, pii, queries


def plan_text(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op5_fair_queue_mix", "op9_line_windows"])
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = con.execute(queries.ORACLE[name]).df()[got.columns]
    a = sorted(map(tuple, got.toPandas().astype(object).where(lambda d: d.notna(), None).values.tolist()), key=str)
    b = sorted(map(tuple, want.astype(object).where(lambda d: d.notna(), None).values.tolist()), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y) if isinstance(x[-1], float) else x[0] == y[0]
    key = lambda rows: {r[0]: r[1:] for r in rows}
    left, right = key(a), key(b)
    for i in left:
        for u, v in zip(left[i], right[i]):
            assert u == pytest.approx(v) if isinstance(u, (int, float)) else u == v


@pytest.mark.parametrize("name", ["op5_fair_queue_mix", "op9_line_windows", "op10_pii_pseudonyms"])
def test_native_queries_run_no_python(spark, data, name):
    assert not re.search("Python|Pandas|Arrow", plan_text(queries.QUERIES[name](spark, data)))


# --- mixing -----------------------------------------------------------------

DOC = "doc_id long, text string, source string"


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
            left -= out[s]
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 1}, {"a": 5, "b": 1000, "c": 2, None: 7, "é": 30, "Z": 90}, {f"s{i}": 1 + 7 * i % 50 for i in range(20)}, {"a": 0, "b": 5}])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_taken_words_come_near_the_targets(spark, data):
    rows = mixing.plan(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by, largest = {}, max(r["size"] for r in rows)
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= largest for target, taken in by.values())


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "p q r", "a"), (4, "same text", "b"), (4, "same text", "b"), (5, "x " * 5000, "c")]
    cols = ["doc_id", "source", "size", "taken", "copies"]
    first, again = (sorted((tuple(r) for r in mixing.plan(spark.createDataFrame(rows, DOC)).select(*cols).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    taken = {(r[0], r[2]): r[3] for r in first}
    assert taken[(1, 0)] == 0 and taken[(2, 0)] == 0
    assert sum(r[3] for r in first) <= sum(r[2] for r in first)
    assert mixing.plan(spark.createDataFrame([], DOC)).collect() == []
    assert mixing.mix(spark.createDataFrame([], DOC)).collect() == []


def brute_mix(rows, most=3):
    """(id, text) of all copies in the queue's order, as (time, id, text); rows are (id, text, source)."""
    size = lambda t: len((t or "").split())
    digest = lambda r: hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = filled(sizes)
    queue = []
    for s in sizes:
        upto = 0
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (digest(r), r[0] or 0, size(r[1])))
        for r in own:
            upto += size(r[1])
            queue += [((k * sizes[s] + upto) / target[s], digest(r), r) for k in range(most) if size(r[1])]
    out, words = [], 0
    for time, _, r in sorted(queue, key=lambda q: q[:2]):
        words += size(r[1])
        if words > sum(sizes.values()):
            break
        out.append((time, r[0], r[1]))
    return out


def test_mix_and_plan_equal_the_queue_by_brute_force(spark):
    rows = [(i, " ".join(["w"] * (1 + 37 * i % 50)), "abc"[i * i % 3]) for i in range(60)]
    want = brute_mix(rows)
    df = spark.createDataFrame(rows, DOC)
    assert sorted((r["doc_id"], r["text"]) for r in mixing.mix(df).collect()) == sorted(w[1:] for w in want)
    times = {}
    for time, i, _ in want:
        times.setdefault(i, []).append(time)
    order = [times[r["doc_id"]].pop(0) for r in mixing.mix(df).collect()]  # each copy stands at its own finish time
    assert order == sorted(order)
    taken = {r["doc_id"]: r["copies"] for r in mixing.plan(df).collect()}
    assert taken == {i: sum(w[1] == i for w in want) for i, *_ in rows}


def test_equal_rows_and_equal_ids_are_taken_as_planned(spark):
    rows = [(1, "a b", "s"), (1, "c d", "s"), (1, "e f", "s"), (2, "same text here", "t"), (2, "same text here", "t"), (2, "same text here", "t"), (None, "q r", "t"), (None, "q r", "t"), (3, "u", "u")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOC + ", no int")
    planned = sorted((r["doc_id"] or 0, r["source"], r["size"], r["copies"]) for r in mixing.plan(df).collect())
    got = {}
    for r in mixing.mix(df).collect():
        got[r["no"]] = got.get(r["no"], 0) + 1
    assert sorted((i or 0, s, len(t.split()), got.get(k, 0)) for k, (i, t, s) in enumerate(rows)) == planned
    assert sum(r[2] * r[3] for r in planned) <= sum(len(t.split()) for _, t, _ in rows)


def test_mix_returns_the_documents_with_all_their_columns(spark):
    df = spark.createDataFrame([(i, f"w{i} x y", "ab"[i % 2], i * 10, "t") for i in range(20)], DOC + ", _time long, _nth string")
    out = mixing.mix(df)
    assert out.columns == df.columns
    rows = out.collect()
    counts = {r["doc_id"]: r["copies"] for r in mixing.plan(df).collect()}
    assert {i: sum(r["doc_id"] == i for r in rows) for i in counts} == counts
    assert all(r["_time"] == r["doc_id"] * 10 for r in rows)


# --- lines ------------------------------------------------------------------


def brute_lines(rows):
    """{row: text} after removing later three-line windows; rows sorted as (id, text)."""
    first, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w not in first:
                first[w] = (k, p)
                continue
            at = max(p, first[w][1] + 3) if first[w][0] == k else p
            gone.setdefault(k, set()).update(range(at, p + 3))
    return {rows[k][0]: None if rows[k][1] is None else "\n".join(x for i, x in enumerate(rows[k][1].split("\n")) if i not in gone.get(k, ())) for k in order}


LINES = [
    (1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\nd\ne"), (4, "z\nz\nz\nz\nz\nz\nz"), (5, None), (6, ""), (7, "a\nb"), (8, "\n\n\n\n"), (9, "a\nb\nc\na\nb\nc"),
    (10, "q\nz\nz\nz\nz\nq"), (11, "\n".join(f"l{i}" for i in range(3000))), (12, "\n".join(f"l{i}" for i in range(1500, 4000))), (13, " \n\t\nk"), (14, "m\n \n\t\nk\nn"),
]


def test_line_dedup_equals_brute_force(spark):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(LINES, "doc_id long, text string")).collect()}
    assert got == brute_lines(LINES)


def test_line_dedup_counts_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 7, "keep", 1) for r in LINES], "doc_id long, text string, n_chars long, _new string, _n_lines int")
    out = line_dedup.dedup(df, count_col="n_chars")
    assert out.columns == ["doc_id", "text", "n_chars", "_new", "_n_lines", "_n_removed"]
    for r in out.collect():
        assert r["_new"] == "keep" and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert r["_n_lines"] - r["_n_removed"] == (0 if not r["text"] and r["_n_removed"] == r["_n_lines"] else len(r["text"].split("\n")))


def test_line_dedup_of_null_ids_repeated_rows_and_nothing(spark):
    t = "a\nb\nc"
    rows = [(None, t), (1, t), (1, t), (2, t)]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, ""), (1, ""), (2, ""), (None, t)]
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- pseudonyms -------------------------------------------------------------


def pseudonyms(spark, values, key="k"):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(pii.pseudonym(F.col("v"), key)).collect()]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_digits_are_permuted(spark):
    for n in (2, 3):
        values = [f"{i:0{n}d}" for i in range(10**n)]
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = [r[0] for r in df.select(pii.permute_digits(F.col("v"), "k", "t")).collect()]
        assert sorted(got) == values and got != values


def test_cards_keep_valid_check_digits_and_invalid_numbers_stay(spark):
    valid = [s + d for s in ("411111111111111", "49927398", "12345678901234567", "000000000000") for d in "0123456789" if luhn(s + d) and len(s) >= 12]
    bad = ["4111111111111112", "1234567890123"]
    got = pseudonyms(spark, valid + bad)
    assert all(luhn(x) and len(x) == len(v) and x != v for x, v in zip(got, valid))
    assert got[len(valid) :] == bad


def test_every_day_maps_to_another_day_once(spark):
    first = datetime.date(1900, 1, 1)
    days = [(first + datetime.timedelta(n)).isoformat() for n in range(0, pii.DAYS, 9)]
    got = pseudonyms(spark, days)
    assert len({*got}) == len(days)
    assert all(first <= datetime.date.fromisoformat(x) <= datetime.date(2099, 12, 31) for x in got)
    one = pseudonyms(spark, ["2024-02-29", "29.02.2024", "02/29/2024", "2023-02-29", "31.04.2020", "1850-01-01"])
    d = datetime.date.fromisoformat(one[0])
    assert one[1] == d.strftime("%d.%m.%Y") and one[2] == d.strftime("%m/%d/%Y")
    assert one[3:] == ["2023-02-29", "31.04.2020", "1850-01-01"]


def test_formats_are_kept(spark):
    values = ["+1 (017) 555-7713", "415-555-0000", "123-45-6789", "10.0.0.1", "999.1.1.1", "jo.do-3@mail.example.com", "a@b.co", "_@b.co"]
    got = pseudonyms(spark, values)
    shape = lambda s: re.sub("[0-9]", "9", s)
    assert [shape(x) for x in got[:3]] == [shape(x) for x in values[:3]]
    assert all(0 <= int(o) <= 255 for o in got[3].split(".")) and got[4] == values[4]
    assert re.fullmatch(r"[A-Za-z0-9]{2}\.[A-Za-z0-9]{2}-[A-Za-z0-9]@mail\.example\.com", got[5])
    assert got[5] != values[5] and got[7] == values[7]


def test_addresses_are_permuted_one_to_one(spark):
    values = [f"10.{i}.{j}.7" for i in range(30) for j in range(30)]
    assert len({*pseudonyms(spark, values)}) == len(values)
    local = [f"{a}{b}@x.org" for a in pii.LETTERS for b in pii.LETTERS]
    got = pseudonyms(spark, local)
    assert sorted(got) == sorted(local)


def test_texts_link_equal_values_and_leave_the_rest(spark):
    a, b = "call +1 (017) 555-7713 or 4111111111111111.", "été 4111111111111111, id 4111111111111112 v1.2.3.4.5 token = \"5d190bd7c06284de91015a3697474879\""
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, ""), (5, "no data " * 5000), (1, a)], "doc_id long, text string")
    rows = pii.pseudonymise(df, "key").collect()
    by = {r["doc_id"]: r for r in rows}
    card = re.search("[0-9]{16}", by[1]["text"])[0]
    assert card in by[2]["text"] and card != "4111111111111111" and luhn(card)
    assert by[2]["text"].replace(card, "4111111111111111") == b
    assert by[3]["text"] is None and by[4]["text"] == "" and by[5]["text"] == "no data " * 5000
    assert (by[1]["_n_found"], by[1]["_n_replaced"], by[3]["_n_found"]) == (2, 2, 0)
    assert len({r["text"] for r in rows if r["doc_id"] == 1}) == 1
    other = pii.pseudonymise(df, "another").where("doc_id = 1").first()["text"]
    assert other != by[1]["text"]


def test_pseudonyms_of_nothing_and_clashing_columns(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []
    df = spark.createDataFrame([(1, "a@b.co", "x", "y", 4)], "doc_id long, text string, found string, _new string, _n_found int")
    r = pii.pseudonymise(df, "k").first()
    assert r.asDict().keys() == {"doc_id", "text", "found", "_new", "_n_found", "_n_replaced"}
    assert (r["found"], r["_new"], r["_n_found"]) == ("x", "y", 1)


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_bank_accounts_cards_in_groups_and_more_phones(spark):
    # published example numbers
    ibans = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
    bad = ["GB82WEST12345698765431", "DE89370400440532013001"]
    got = pseudonyms(spark, ibans + bad)
    assert all(iban_ok(x) and x != v for x, v in zip(got, ibans)) and got[len(ibans) :] == bad
    assert got[0].replace(" ", "") == got[1] and [c == " " for c in got[0]] == [c == " " for c in ibans[0]]
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005"]
    got = pseudonyms(spark, [*cards, "4111 1111 1111 1112"])
    assert got[1].replace(" ", "") == got[0] == got[2].replace("-", "") and got[3].replace(" ", "") == got[4] and got[5] == "4111 1111 1111 1112"
    assert all(luhn(re.sub("[ -]", "", x)) for x in got[:5])
    phones = ["+1 (415) 555-2671", "(415) 555-2671", "415-555-2671", "415.555.2671", "+14155552671", "+442071838750"]
    got = pseudonyms(spark, phones)
    assert len({re.sub("[^0-9]", "", x.removeprefix("+1")) for x in got[:5]}) == 1 and got[0] != phones[0]
    assert [re.sub("[0-9]", "9", x) for x in got] == [re.sub("[0-9]", "9", x) for x in phones] and got[5][:3] == "+44" != got[5]
    ssn = ["001-01-0001", "899-99-9999", "665-12-3456", "667-12-3456", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]
    got = pseudonyms(spark, ssn)
    assert got[4:] == ssn[4:] and len({*got}) == 9
    for x in got[:4]:
        a, b, c = map(int, x.split("-"))
        assert 1 <= a <= 899 and a != 666 and b and c


def brute_pseudonyms(spark, texts, key):
    """Python's own search, with every found value looked up one by one."""
    found = {m for t in texts if t for m in re.findall(pii.ANY, t)}
    told = dict(zip(sorted(found), pseudonyms(spark, sorted(found), key)))
    return [None if t is None else re.sub(pii.ANY, lambda m: told[m[0]], t) for t in texts]


def test_the_whole_query_equals_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = dict(zip(texts, brute_pseudonyms(spark, list(texts.values()), queries.TEST_KEY)))
    rows = queries.op10_pii_pseudonyms(spark, data).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_found"] == len(re.findall(pii.ANY, texts[r["doc_id"]] or "")) for r in rows)
    assert sum(r["n_replaced"] for r in rows) > 0


def test_very_long_texts_of_any_shape(spark):
    shapes = [(".c", "a@b"), ("a", ""), ("a.", ""), ("1", ""), ("1 ", ""), ("1234-", ""), ("1.", ""), ("+1", ""), ("@", ""), ("a@", ""), ("GB82 ", ""), ("-", "a@b"), ("%", ""), ("(415) ", ""), ("A1", "GB82")]
    texts = [lead + piece * (1_000_000 // len(piece)) for piece, lead in shapes]
    texts += [t + " x@y.org" for t in texts]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k").collect()}
    for k, text in enumerate(texts):
        assert len(got[k]) == len(text)
