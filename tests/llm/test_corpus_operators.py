"""Operators over whole tables: packing, sharding, archives, decontamination, near copies, languages, the pipeline."""

import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, langid, nearcopies, packing, sharding, tokens, warc
from weftline.llm.components import components

DOCS = "doc_id long, text string"
CLASHING = "doc_id long, text string, bucket int, start int, number int, shard int, digest string, class string, rid long, lang string"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "ion", "de", "la", "que", "ung", "os", "ri"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


# ---- packing


def test_knapsack_against_enumeration():
    from itertools import product

    sizes, worth = np.array([2, 3, 5]), np.array([1.0, 1.7, 2.9])
    best = max((c for c in product(range(6), repeat=3) if np.dot(c, sizes) <= 11), key=lambda c: np.dot(c, worth))
    configs, total = packing.knapsacks(sizes, np.array([9, 9, 9]), worth, 11)
    assert (configs @ sizes <= 11).all() and configs @ worth == pytest.approx(total)
    assert total.max() == pytest.approx(np.dot(best, worth))
    few = np.array([2, 1, 1])  # no size more often than it is needed, and each in some configuration
    configs, total = packing.knapsacks(sizes, few, worth, 11)
    best = max((c for c in product(range(3), range(2), range(2)) if np.dot(c, sizes) <= 11), key=lambda c: np.dot(c, worth))
    assert (configs <= few).all() and (configs.sum(0) > 0).all() and total.max() == pytest.approx(np.dot(best, worth))


@pytest.mark.parametrize("case", ["spread", "few", "same", "one", "none"])
def test_plan_holds_the_histogram(case):
    rng = np.random.default_rng(1)
    lengths = {"spread": rng.integers(300, 1100, 20_000), "few": rng.choice([700, 1025, 341], 500), "same": np.full(1000, 2048), "one": np.array([7]), "none": np.zeros(0, int)}[case]
    histogram = np.bincount(lengths, minlength=2049)
    the_plan, of_program = packing.plan(histogram, 2048)
    held = np.zeros(2049, int)
    for config, times in the_plan:
        assert sum(s * k for s, k in config.items()) <= 2048 and times > 0
        for s, k in config.items():
            held[s] += k * times
    assert (held == histogram).all()
    n = sum(t for _, t in the_plan)
    bound = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert bound <= n <= 1.03 * bound + 1 or case == "few"
    assert sum(t for _, t in the_plan[:of_program]) >= 0.9 * n or case == "one"


def longest_first(histogram, capacity):
    left, out = histogram.copy(), []
    while left.any():
        packing._use(left, packing.fill(left, capacity), int(left.sum()), out)
    return sum(t for _, t in out)


@pytest.mark.parametrize("sf, most", [("sf0.001", 89), ("sf0.01", 442), ("sf0.1", 4539)])
def test_the_plan_is_that_of_the_program(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(8)
    rows = packing.pieces(docs, tokens.vocabulary_path(), 2048, 0).groupBy("length").count().collect()
    histogram = np.zeros(2049, np.int64)
    for r in rows:
        histogram[r["length"]] = r["count"]
    the_plan, of_program = packing.plan(histogram, 2048)
    n = sum(t for _, t in the_plan)
    assert n <= min(most, longest_first(histogram, 2048))
    assert sum(t for _, t in the_plan[:of_program]) >= 0.9 * n


def test_covering_program_is_near_its_optimum():
    # halves and thirds: 1000 pieces of 1024 and 1500 of 682 need 500 + 500 sequences
    got = sum(x for _, x in packing.solve(np.array([682, 1024]), np.array([1500, 1000]), 2048))
    assert 1000 <= got < 1030


def check_packing(docs, rows, capacity):
    v = tokens.vocabulary(tokens.vocabulary_path())
    want = []
    for doc_id, text in docs:
        ids = [*v.library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((doc_id, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.1 * sum(w[3] for w in want) / capacity + 2


def test_packing_is_exact(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, rng.choice([3, 20, 90, 700]))) for i in range(120)] + [(7, None), (7, ""), (None, "x"), (None, "x"), (9, words(rng, 3000))]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "d", "c", 5, "en") for d in docs], CLASHING)
    check_packing(docs, packing.pack(df, capacity=256).collect(), 256)
    assert packing.pack(df.limit(0)).count() == 0


def test_slots_are_gapless_across_chunks(spark):
    df = spark.range(1000).selectExpr("id", "IF(id < 700, 0, id % 3) AS k", "1 AS bucket", "2 AS start")
    rows = common.with_slots(common.stored(common.numbered_chunks(df, "chunk", 16), "slots"), ["k"], ["id"], "slot", "chunk").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == 1000 and rows[0].bucket == 1


def test_rows_that_are_all_equal_are_spread(spark):
    equal = spark.range(300_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text")
    chunks = common.stored(common.numbered_chunks(equal, "chunk"), "slots").groupBy("chunk").count().collect()
    assert len(chunks) > 4 and max(r["count"] for r in chunks) <= common.CHUNK_ROWS
    slots = sharding.shards(equal).agg({"slot": "max", "shard": "max"}).first()
    assert slots["max(slot)"] == 299_999
    packed = packing.pack(equal)
    assert packed.count() == packed.select("sequence_id", "offset").distinct().count() == 300_000
    assert packed.agg({"sequence_id": "max"}).first()[0] == -(-300_000 // 2048) - 1


# ---- sharding


def test_longest_first():
    got = sharding.schedule([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2)
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_shards(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randint(1, 80))) for i in range(2000)] + [(i, "hot text") for i in range(300)] + [(None, None), (None, ""), (5, None)]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "d", "c", 5, "en") for d in docs], CLASHING)
    rows = sharding.shards(df).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) < 0.01 * max(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id is None} == {(1, 0)}
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in docs)
    assert sharding.shards(df.limit(0)).count() == 0


# ---- archives


PAGES = [(1, "http://a.de/ü b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "v\r\nX: y", "é" * 50_000), (5, "v", "é" * 50_000), (None, "w", "<p>x</p>"), (None, "w", "alone"), (6, "z", "small")]


@pytest.mark.parametrize("most", [400_000, 0])
def test_archives_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)  # repeated payloads broadcast, and joined otherwise
    df = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, payload string, sha1 int")
    rows = warc.archive_pages(df).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    d = lambda s: warc.digest((s or "").encode())
    want = [
        (1, 8, d("<p>x</p>"), "revisit", 2), (2, 8, d("<p>x</p>"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None),
        (5, 100_000, d("é" * 50_000), "response", None), (5, 100_000, d("é" * 50_000), "response", None), (None, 8, d("<p>x</p>"), "revisit", 2),
        (None, 5, d("alone"), "response", None), (6, 5, d("small"), "response", None),
    ]
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert warc.archive_pages(df.limit(0)).count() == 0
    big = {tuple(r) for r in warc.archive_pages(df, least_bytes=100).collect()}
    assert (1, 8, d("<p>x</p>"), "response", None) in big


def test_archives_match_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{sf_dir}/pages.parquet' WHERE page_id < 20")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    both = pages.unionByName(pages.filter("page_id < 20").withColumn("page_id", pages.page_id + 1000))
    want = con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall()
    got = [tuple(r) for r in warc.archive_pages(both).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got) == sorted(want) and sum(r[3] == "revisit" for r in got) == 20


def _archive(n=40):
    import io

    records = [warc.encode_record(i, f"http://x/{i}", f"<html><body>text of page number {i}, {i * i}</body></html>".encode(), None, False, "2000-01-01T00:00:00Z") for i in range(n)]
    out = io.BytesIO()
    warc.write_archive(out, iter(records), warc.make_dictionary(records * 5))
    return out.getvalue()


def test_archive_begins_with_its_dictionary_and_has_a_frame_a_record():
    data = _archive()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and size > 0
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    assert [r.page_id for r in warc.read_archive(data)] == list(range(40))
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + size :])  # not without the dictionary


@pytest.mark.parametrize("harm", ["cut", "flip", "magic", "short", "length", "digest", "version"])
def test_invalid_archives(harm):
    data = bytearray(_archive())
    if harm == "cut":
        data = data[:-5]
    elif harm == "flip":
        data[-20] ^= 0xFF
    elif harm == "magic":
        data[0] ^= 1
    elif harm == "short":
        data = data[:6]
    else:
        record = warc.encode_record(1, "u", b"payload", None, False, "d")
        changed = {"length": record.replace(b"Content-Length: 7", b"Content-Length: 8"), "digest": record.replace(b"payload", b"PAYLOAD"), "version": record.replace(b"WARC/1.1", b"WARC/9.9")}[harm]
        data = struct.pack("<II", warc.SKIPPABLE, 0) + zstandard.ZstdCompressor().compress(changed)
    with pytest.raises(warc.Invalid):
        list(warc.read_archive(bytes(data)))


# ---- decontamination

ITEM = "A farmer named Tom sold 12 apples to Maria for 3 dollars each and then gave Tom another 12 kg of pears for nothing at all."


@pytest.mark.parametrize(
    "text, found, exact",
    [
        (ITEM, True, True),
        ("Before it. " + ITEM.upper().replace("A FARMER", "A farmer") + " After.", None, None),
        ("x y z " + ITEM.replace("Tom", "John Smith").replace("12", "4,500").replace("Maria", "Eve") + " more", True, False),
        ("x " + ITEM.replace("Tom another", "Ann another").replace("Tom", "Bob").replace("sold 12", "sold 77").replace("for 3", "for 5").replace("Maria", "Eve").replace("another 12", "another 88"), False, None),
        ("x " + ITEM.replace("named Tom", "named Bob"), True, True),  # one slot contradicts, but a long passage is the item's own
        (" ".join(ITEM.split()[:7]), False, None),
        ("nothing in common with it here", False, None),
        (None, False, None),
        ("", False, None),
    ],
)
def test_templates_and_slots(spark, text, found, exact):
    docs = spark.createDataFrame([(1, text)], DOCS)
    bench = spark.createDataFrame([(9, ITEM), (10, None), (None, "..."), (11, "")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    if found is not None:
        assert len(rows) == found
    if found:
        assert rows[0].item_ids == [9] and rows[0].exact == exact
    assert decontaminate.without_contaminated(docs, bench).count() == 1 - len(rows)


def lined_up(item, text):
    found = decontaminate.Benchmark([9], [item]).matches(pa.array([text]), decontaminate.LEAST_WORDS, decontaminate.LEAST_SHARE)
    return [(m.words, m.share, m.exact) for m in found.get(0, [])]


TWICE = "Tom has 3 red apples in a bag. Tom puts them on the table. How many does Tom see?"


def test_names_by_several_typings():
    for text in (ITEM.lower(), ITEM.upper(), "Before it. " + ITEM.upper().replace("A FARMER", "A farmer") + " After."):
        assert lined_up(ITEM, text) == [(26, 1.0, True)]
    for sep in ("\n", ' "'):
        assert lined_up(ITEM, ITEM.replace(" Tom", sep + "Tom").replace(" Maria", sep + "Maria")) == [(26, 1.0, True)]
        assert lined_up(ITEM, ITEM.replace(" Tom", sep + "Bob").replace(" Maria", sep + "Eve").replace("12", "13"))[0][2] is False
    assert lined_up(TWICE, "Q: " + TWICE.replace("Tom", "Bob").replace("3", "7")) == [(19, 1.0, False)]
    assert not lined_up(TWICE, TWICE.replace("Tom puts", "Ann puts").replace("does Tom", "does Eve").replace("Tom has", "Bob has"))


MIDDLE = "we count the small green boats that pass by 5 tall towers near the old stone bridge each morning before rain"
SHORT = "the old miller grinds white flour under seven wooden wheels near our river"


def test_parts_of_an_item_off_their_places():
    for new, equal in (("twenty five", False), ("25", False), ("sixty-one", False), ("about 5", True), ("5 or 6", True)):
        (words, _, exact), = lined_up(MIDDLE, "x y " + MIDDLE.replace("5", new) + " z")
        assert words >= 20 and exact == equal
    assert lined_up(MIDDLE, MIDDLE.replace("tall ", ""))[0][0] >= 19
    assert lined_up(SHORT, SHORT.replace("under", "finely under")) == [(13, 1.0, True)]
    a, b = MIDDLE.split(" tall ")
    assert not lined_up(MIDDLE, b + " and " + a) and not lined_up(MIDDLE, a + " so" * 20 + " " + b)  # another order, far apart
    assert not lined_up(MIDDLE.replace("stone", "5 stone"), MIDDLE.replace("5", "7 very").replace("stone", "9 stone"))  # slots of a chain
    assert len(decontaminate.templates(pa.array(["two, three", "twenty-one 3 million"]))[0].token) == 4


SUMS = "Solve 3x + 5 = 20 and 2y - 4 = 10 for x and y."


def test_items_rich_in_numbers():
    assert lined_up(SUMS, "so " + SUMS + " ok") == [(14, 1.0, True)] and not lined_up(SUMS, SUMS.replace("20", "30").replace("10", "40").replace("3x", "7x"))
    assert lined_up("What is 7 times 8", "q: what is 7 times 8 now") == [(5, 1.0, True)] and not lined_up("What is 7 times 8", "what is 7 times 9")
    assert lined_up("1 2 3 5 8 13 21 34 55", "x 1 2 3 5 8 13 21 34 55") == [(9, 1.0, True)] and not lined_up("1 2 3 5 8 13 21 34 55", "x 9 2 3 5 8 13 20 34 55")


def test_units_by_their_place():
    item = "A train goes 40 miles in 2 hours and then stops at the old station for a while"
    (words, _, exact), = lined_up(item, item.replace("40 miles", "60 leagues").replace("2 hours", "3 fortnights"))
    assert words >= 13 and not exact


NAMES = "Tom Anna Bob Maria Igor Chen Fatima Lars Pedro Yuki".split()
UNITS = "km kg hours euros litres miles".split()


def random_item(rng, plain):
    """Tokens of a question: literals, and slots as (kind, number of its filler)."""
    out = []
    for _ in range(rng.randint(18, 34)):
        x = rng.random()
        if x < 0.1:
            out.append(("number", rng.randrange(3)))
        elif x < 0.15 and out and out[-1][0] != "name":
            out.append(("name", rng.randrange(2)))
        else:
            out.append(("word", rng.choice(plain)))
        if out[-1][0] == "number" and rng.random() < 0.5:
            out.append(("unit", rng.randrange(2)))
    return out


def filled(rng, tokens, broken=False):
    fill = {"number": rng.sample(range(2, 900), 3), "name": rng.sample(NAMES, 2), "unit": rng.sample(UNITS, 2)}
    out = []
    for kind, k in tokens:
        out.append(k if kind == "word" else str(fill[kind][k] if not (broken and kind == "number" and rng.random() < 0.5) else rng.randrange(1000, 9999)))
    return " ".join(out)


def brute_template(item, text):
    """Whether a text holds an item's template as a whole with fillers that correspond one to one, token by token."""
    def typed(s):
        out = []
        for w in re.findall(r"\w+", s):
            kind = "number" if w.isdigit() else "name" if w in NAMES else "unit" if w in UNITS and out and out[-1][0] == "number" else "word"
            out.append((kind, w if kind != "word" else w.lower()))
        return out

    a, b = typed(item), typed(text)
    for at in range(len(b) - len(a) + 1):
        forth, back = {}, {}
        if all(x[0] == y[0] and (x[1] == y[1] if x[0] == "word" else forth.setdefault(x[1], y[1]) == y[1] and back.setdefault(y[1], x[1]) == x[1]) for x, y in zip(a, b[at:])):
            return True
    return False


def test_reparameterised_items_against_brute_force():
    rng = random.Random(12)
    plain = list(dict.fromkeys("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)))
    tokens = [random_item(rng, plain) for _ in range(150)]
    items = [filled(rng, t) for t in tokens]
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    texts, source = [], []
    for k in range(600):
        kind = ("again", "broken", "clean")[k % 3]
        i = rng.randrange(150)
        body = prose(40) if kind == "clean" else filled(rng, tokens[i], kind == "broken")
        texts.append(f"{prose(12)} {body} {prose(12)}")
        source.append((kind, i))
    found = decontaminate.Benchmark(list(range(150)), items).matches(pa.array(texts), decontaminate.LEAST_WORDS, decontaminate.LEAST_SHARE)
    want = {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if brute_template(x, t)}
    got = {(k, m.item_id) for k, of in found.items() for m in of}
    assert len(want) >= 200 and len(want & got) / len(want) >= 0.98
    # what is found beside whole templates: parts of an item that line up, none in prose alone
    assert not [k for k, _ in got if source[k][0] == "clean"] and all(source[k][1] == i for k, i in got)
    assert len({k for k, _ in got if source[k][0] == "broken"} - {k for k, _ in want}) <= 0.5 * 200


def test_items_of_one_template_are_one_class(spark):
    items = [(x * 100 + y, f"Tom has {x} red apples and buys {y} green pears at the shop on Monday for 5 euros in total") for x in range(20, 65) for y in range(20, 65)]
    bench = spark.createDataFrame([*items, (None, "a text that no document holds anywhere at all in this small world")], "item_id long, text string")
    other = "Bob has {} red apples and buys {} green pears at the shop on Friday for 7 euros in total"
    docs = [(i, "Well. " + other.format(100 + i, 200 + i)) for i in range(50)] + [(50, items[700][1]), (51, other.format(9, 9)), (52, "so " + items[46 * 3][1].replace("5 euros", "6 euros"))]
    rows = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(docs, DOCS), bench).collect()}
    free = [i for i, t in items if len(set(re.findall(r"\d+", t))) == 3]
    same = [i for i, t in items if len(set(re.findall(r"\d+", t))) == 2]
    assert set(rows) == set(range(53)) and all(min(free) in rows[i].item_ids and len(rows[i].item_ids) <= 2 and rows[i].n_items >= len(free) and not rows[i].exact for i in range(50))
    assert rows[50].exact and items[700][0] in rows[50].item_ids and min(same) in rows[51].item_ids and rows[51].n_items >= len(same)
    classes = {r.item_id: r.class_id for r in decontaminate.item_classes(bench).collect()}
    assert len(classes) == len(items) + 1 and {classes[i] for i in free} == {min(free)} and {classes[i] for i in same} == {min(same)} and classes[None] is None
    block = decontaminate.Benchmark([i for i, _ in items], [t for _, t in items])
    import time

    began = time.time()
    assert len(block.matches(pa.array([t for _, t in docs[:50]]), 13, 0.8)) == 50 and time.time() - began < 1


def test_decontamination_against_brute_force_and_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(3, 40))) for i in range(30)]
    docs = []
    for i in range(300):
        t = words(rng, rng.randint(5, 60))
        if i % 5 == 0:
            t += " " + rng.choice(items)[1] + " " + words(rng, 5)
        docs.append((i, t))
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "d", "c", 5, "en") for d in docs], CLASHING)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, x in items if re.search(rf"\b{x}\b", t)}
    got = {(r.doc_id, i) for r in decontaminate.contaminated(df, bench).collect() for i in r.item_ids}
    assert got == want and len(want) >= 60
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", ("item_id", "text", 500))
    assert {(r.doc_id, i) for r in decontaminate.contaminated(df, bench).collect() for i in r.item_ids} == want
    other = bench.withColumnsRenamed({"item_id": "id", "text": "question"})
    assert {r.doc_id for r in decontaminate.contaminated(df, other, item_id_col="id", item_text_col="question").collect()} == {d for d, _ in want}
    kept = decontaminate.without_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


# ---- near copies


def brute_links(docs, threshold=0.5, n=3):
    texts = defaultdict(list)
    for doc_id, t in docs:
        texts[t or ""].append(doc_id)
    sets = {}
    for t in texts:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        sets[t] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links, near = defaultdict(int), defaultdict(set)
    every = list(texts)
    for i, a in enumerate(every):
        for b in every[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    least, done = {}, set()
    for t in every:
        if t in done:
            continue
        group, todo = {t}, [t]
        while todo:
            for x in near[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        done |= group
        ids = [i for x in group for i in texts[x] if i is not None]
        for x in group:
            least[x] = min(ids) if ids else None
    return {t: (least[t], len(near[t]), len(ids)) for t, ids in texts.items()}


def near_docs(rng, n_hot=60):
    docs = [(i, words(rng, rng.randint(4, 60))) for i in range(150)]
    hot = words(rng, 120).split()
    for k in range(n_hot):
        w = list(hot)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000 + k, " ".join(hot)) for k in range(40)]
    return docs + [(3000, None), (3001, ""), (None, "!!"), (3002, "one"), (3003, "One."), (None, " ".join(hot)), (5, docs[5][1]), (5, docs[5][1])]


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK_MEMBERS", block)
    docs = near_docs(random.Random(8))
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "d", "c", 5, "en") for d in docs], CLASHING)
    want = brute_links(docs)
    got = nearcopies.near_copies(df).collect()
    texts = dict(enumerate(docs))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=key)
    assert rows == sorted(((i, *want[t or ""]) for i, t in texts.values()), key=key)


def test_first_of_each_class(spark):
    docs = near_docs(random.Random(9), 20)
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "d", "c", 5, "en") for d in docs], CLASHING)
    kept = nearcopies.first_of_each(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    want = brute_links(docs)
    classes = {want[t or ""][0] for _, t in docs if want[t or ""][0] is not None}
    ids = [r.doc_id for r in rows]
    assert {i for i in ids if i is not None} == classes and len(ids) == len(classes) + 1  # and the text of null ids alone
    assert nearcopies.first_of_each(df.limit(0)).count() == 0 and nearcopies.near_copies(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.7, 0.9):
        b, r = nearcopies.Banding(threshold=threshold).shape()
        assert b * r <= 200 and 1 - (1 - threshold**r) ** b >= 0.95


def test_components_of_random_graphs(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for local in (1_000_000, 0):  # in one task, and by stars
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
        assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
        assert components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_rows_are_sifted(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "concat('k', id % 1000) AS key", "1 AS mark", "2 AS bits", "3 AS `at`")
    keys = spark.range(0, 1000, 7).selectExpr("concat('k', id) AS key")
    for bits in (1 << 25, 1 << 10):  # marks enough for the keys, and too few
        monkeypatch.setattr(common, "MOST_MARK_BITS", bits)
        maybe, never = common.sift(df, "key", keys)
        assert maybe.columns == never.columns == df.columns
        a, b = ({r.id for r in x.collect()} for x in (maybe, never))
        assert not a & b and len(a) + len(b) == 3000 and {i for i in range(3000) if i % 1000 % 7 == 0} <= a
        assert len(a) < 600 or bits == 1 << 10


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id", "IF(id < 3000, 0, id % 100) AS k")
    sizes = common.stored(df.groupBy("k").count(), "sizes")
    got = common.join_hot(df, sizes, "k", "count").collect()
    assert len(got) == 6000 and {r.id for r in got} == set(range(6000)) and {r.k: r["count"] for r in got} == {r.k: r["count"] for r in sizes.collect()}


def test_a_chain_of_texts(spark, monkeypatch):
    names = [f"w{i}" for i in range(20_000 + 12)]
    docs = [(i, " ".join(names[i : i + 12])) for i in range(20_000)]  # 10 grams each; links to those up to 3 places off
    rows = nearcopies.near_copies(spark.createDataFrame(docs, DOCS).repartition(8)).collect()
    assert len(rows) == 20_000 and {r.class_id for r in rows} == {0}
    assert {r.doc_id: r.n_links for r in rows} == {i: min(3, i) + min(3, 19_999 - i) for i in range(20_000)}


def test_two_very_long_texts(spark):
    base = " ".join(f"{i:x}" for i in range(3_100_000))
    docs = spark.createDataFrame([(2, base + " end"), (1, base), (3, "short")], DOCS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearcopies.near_copies(docs).collect()}
    assert len(base) > 20_000_000 and got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_equal_rows_are_one_text(spark):
    docs = spark.range(300_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'all rows hold this very text' AS text")
    got = nearcopies.near_copies(docs).groupBy("class_id", "n_links", "n_copies").count().collect()
    assert [tuple(r) for r in got] == [(None, 0, 300_000, 300_000)] and nearcopies.first_of_each(docs).count() == 1


# ---- languages


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_edge_cases(spark):
    docs = [(i, t, g, 1) for i in range(60) for t, g in [(f"the cat and the dog {i}", "en"), (f"der hund und die katze {i}", "de")]]
    docs += [(1, None, "en", 1), (None, "", "en", 1), (2, "12 34 !!", None, 1), (3, "the dogs", None, 1), (4, "hunde katzen", "xx", 1), (5, "the " * 50_000, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect()]
    assert len(got) == len(docs)
    assert all((p == "und") == (s == 0) for _, p, s in got) and sum(p == "und" for _, p, _ in got) == 3
    held = {r.doc_id: r.held_out for r in langid.identify(df).collect()}
    assert all(h == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) for i, h in held.items())
    assert langid.identify(df.limit(0)).count() == 0
    nothing = df.filter("lang IS NULL")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_labels_are_values(spark):
    labels = ["EN", "en", "w", "_every", "a`b", "", "code", "a b", "lang.x"]
    texts = {g: f"{'abcdefghi'[k] * 3}{'jklmnopqr'[k] * 2}" for k, g in enumerate(labels)}
    docs = [(i, f"{texts[g]} {texts[g]}{i % 5 * 'z'}", g) for i in range(30) for g in labels]
    docs += [(100, t, None) for t in ("\u00b2", "\u00bd 5", "\u2167", "12", "\u2167 \u00b2!")]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert sorted(r.lang_pred for r in got) == sorted([g for _, _, g in docs[:-5]] + ["und"] * 5)


def brute_languages(rows):
    """Predictions by dictionaries, a word and an n-gram at a time."""
    import regex

    found = lambda text: regex.findall(r"\p{L}+", text.lower())
    free = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None]
    langs = sorted({r.lang for r in free})
    counts = {n: defaultdict(lambda: [0] * len(langs)) for n in range(5)}
    for lang, text in {(r.lang, r.text) for r in free}:
        for w in found(text):
            counts[0][w][langs.index(lang)] += 1
            for n in range(1, 5):
                for k in range(len(w) + 3 - n):
                    counts[n][f" {w} "[k : k + n]][langs.index(lang)] += 1
    totals = {n: [sum(c[k] for c in t.values()) + 0.5 * len(t) for k in range(len(langs))] for n, t in counts.items()}
    logs = lambda n, key: np.log(np.array(counts[n][key]) + 0.5) - np.log(totals[n])

    def word(w):
        if w in counts[0]:
            return logs(0, w)
        for n in (4, 3, 2, 1):
            known = [x for k in range(len(w) + 3 - n) if (x := f" {w} "[k : k + n]) in counts[n]]
            if known:
                return np.mean([logs(n, x) for x in known], 0)
        return np.zeros(len(langs))

    out = []
    for r in rows:
        ws = found(r.text or "")
        if not ws:
            out.append((r.doc_id, "und", 0.0))
            continue
        total = sum(map(word, ws))
        p = np.exp((total - total.max()) * min(1.0, 10 / len(ws)))
        out.append((r.doc_id, langs[int(total.argmax())], 1 / p.sum()))
    return out


def test_languages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(8)
    odd = [(10_000 + i, t, None, "x", 1) for i, t in enumerate(["zzyzx qqqq", "\u4e2d\u6587" * 40, "\u00e9t\u00e9 na\u00efve \u00c9T\u00c9", "x" * 5000, "a1b2c3", None, "", " ".join(words(rng, 3)[::-1] for _ in range(50))])]
    docs = docs.select("doc_id", "text", "lang", "source", F.lit(1).alias("n_chars")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int"))
    want = sorted(brute_languages(docs.collect()))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-4)


def test_parts_of_texts_give_the_same(monkeypatch):
    col = pa.array(["the cat \u00e9t\u00e9 " * 30 + "zebra" * 40, "", "\u4e2d\u6587x" * 30, "12"])
    table = lambda n: langid.Table.of(*map(np.concatenate, zip(*[(np.unique(g), np.full(len(np.unique(g)), k), np.arange(1, len(np.unique(g)) + 1)) for k, g in enumerate(known[n])])), 2)
    known = defaultdict(list)
    for text in ("cat the zeb", "\u00e9t\u00e9s \u4e2d"):
        buf, starts, ends, h, _ = langid.words(pa.array([text]))
        known[0].append(h)
        for n, g, _ in langid.n_grams(buf, starts, ends):
            known[n].append(g)
    model = langid.Model(["a", "b"], table(0), {n: table(n) for n in langid.ORDERS})
    whole = model.scores(col)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    monkeypatch.setattr(langid, "CHARACTERS", 11)
    monkeypatch.setattr(langid, "CELLS", 4)
    parts = model.scores(col)
    assert parts[1].tolist() == whole[1].tolist() and np.allclose(parts[0], whole[0])


# ---- the pipeline


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    from weftline.llm import pii, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept, frames, df = set(rows), {}, docs
    for name, stage in corpus_pipeline.STAGES:
        df = common.stored(stage(spark, df, sf_dir), name)
        frames[name] = df
    good = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    kept &= good
    assert {r.doc_id for r in frames["quality_rules"].collect()} == kept
    links = brute_links([(i, rows[i].text) for i in sorted(kept)])
    kept = {links[rows[i].text][0] for i in kept}
    assert {r.doc_id for r in frames["near_duplicates"].collect()} == kept
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    kept = {i for i in kept if not any(flat(x) in flat(rows[i].text) for x in items)}
    assert {r.doc_id for r in frames["decontamination"].collect()} == kept
    trees = pii.model()
    texts = {r.doc_id: r for r in frames["personal_data"].collect()}
    assert set(texts) == kept
    for i, r in texts.items():
        assert r.text == pii.redact(rows[i].text, pii.spans(rows[i].text, trees)[1]) and r.n_chars == len(r.text)
    check_packing([(i, texts[i].text) for i in kept], frames["packing"].collect(), 2048)
    assert all(frames[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in frames["packing"].collect())


def test_every_stage_takes_odd_tables(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(12)
    long = words(rng, 60)
    rows = [(1, long, None, "s", None), (1, long, None, "s", None), (None, long + " x", "en", None, 5), (2, None, "de", "s", 0), (3, "", None, None, None), (4, words(rng, 20_000), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, schema)
    extra = spark.createDataFrame([(*r, 1, "d", 2, 3, "k") for r in rows], schema + ", digest int, piece string, rank int, start int, kept string")
    for docs in (plain, extra, plain.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            kept = out.collect()
            if docs is plain:
                want = {"quality_rules": 4, "near_duplicates": 3, "decontamination": 6, "personal_data": 6}[name]
                assert len(kept) == want, (name, len(kept))
            if docs is not plain and docs is not extra:
                assert kept == []
        check_packing([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), 2048)
