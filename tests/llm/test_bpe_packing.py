import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlog.llm.bpe import LONG, decode, encode, token_counts
from lumenlog.llm.packing import pack, plan

TEXTS = [
    None, "", " ", "\n\n", "Hello world", "it's we'll I'd", "<|endoftext|> stays text", "naïve coöp Ω≈ç√ 監視中 تم 👍🏽​", "a b c\u0085d", "\r\n\t x  y   z", "1234567890 3.14 x86_64", "ZzQqXx" * 30, "=" * 100, "x" * (LONG + 50), " " * (LONG + 9) + "end", "é" * 2000 + " tail",
    "The quick brown fox. " * 2000, "́̀ combining", "ab" * 5000,
]


def test_ids_equal_the_library_and_decode(spark):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([*enumerate(TEXTS), (0, None)], "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as known")
    for words in (32_768, 3):  # a table of 3 words: nearly all come by the join
        got = encode(df, table_words=words)
        assert got.columns == ["doc_id", "text", "known", "ids"]
        rows = got.collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids, r["text"]
        sizes = token_counts(df.withColumn("m", F.create_map("doc_id", "text")), table_words=words).collect()
        assert [(r["doc_id"], r["tokens"]) for r in sizes if r["tokens"] != len(t.encode(r["text"] or "", add_special_tokens=False).ids)] == [] and len(sizes) == len(TEXTS) + 1
    back = {r["doc_id"]: r["back"] for r in decode(got.drop("text"), out="back").collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    assert encode(df.limit(0)).count() == 0


def joined(plan):
    """Types of the columns that the joins of a plan take."""
    inputs = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [x.output().apply(i).dataType().catalogString() for x in inputs if plan.nodeName() == "Join" for i in range(x.output().size())]
    return own + [kind for x in inputs for kind in joined(x)]


def test_rare_words_are_joined_without_the_table(spark):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    # A number of its own in each text, texts without one, rows that are the same.
    texts = [*[f"line {i * 7919} of {i % 3} lines, line {i * 7919}" for i in range(300)], *["of lines"] * 20, *["same 4711 4711"] * 20, None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for make, result in ((encode, list), (token_counts, len)):
        got = make(df, out="made", table_words=8)
        kinds = joined(got._jdf.queryExecution().optimizedPlan())
        assert "string" in kinds and not [x for x in kinds if x.startswith("array<map<")]
        rows = got.collect()
        assert len(rows) == len(texts) and [r for r in rows if r["made"] != result(t.encode(r["text"] or "", add_special_tokens=False).ids)] == []


def fill(placed, capacity):
    room = {}
    for c, s in placed:
        room[c] = room.get(c, 0) + s
    assert max(room.values()) <= capacity and sorted(room) == list(range(len(room)))
    return sum(room.values()) / (capacity * len(room))


def test_plan_covers_every_item():
    r = random.Random(3)
    for _ in range(40):
        counts = {r.randint(0, 100): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        ranges, containers = plan(counts, 100)
        placed = [(first + (i - low + shift) // each, s) for s, low, high, first, each, shift in ranges for i in range(low, high)]
        assert {s: sum(1 for _, x in placed if x == s) for s in counts} == counts
        assert len({c for c, _ in placed} | {0}) <= containers
        room = {}
        for c, s in placed:
            room[c] = room.get(c, 0) + s
        assert max(room.values()) <= 100


def test_containers_of_a_class_hold_its_number_of_items():
    # Class 3 (26 to 33 of 100) alone: three items each, of unequal sizes; only the last container may hold fewer.
    counts = {33: 4, 31: 1, 30: 5, 27: 4}
    ranges, containers = plan(counts, 100)
    placed = [first + (i - low + shift) // each for _, low, high, first, each, shift in ranges for i in range(low, high)]
    assert containers == 5 and sorted(map(placed.count, range(5))) == [2, 3, 3, 3, 3]
    # Smaller items first take what the classes before left over.
    assert plan({60: 3, 40: 3, 5: 1}, 100)[1] == 4 and plan({60: 3, 40: 2, 20: 2}, 100)[1] == 3


def test_pack(spark):
    r = random.Random(4)
    sizes = [int(r.lognormvariate(5, 1.2)) for _ in range(3000)] + [0, 0, None, -5, 2048, 2049, 10_000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int").selectExpr("*", "1 as piece", "2 as container")
    rows = pack(df, "doc_id", "tokens", 2048, chunk_items=500).collect()
    assert len({(x["doc_id"], x["piece"]) for x in rows}) == len(rows)
    total = {}
    for x in rows:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["size"]
        assert x["size"] == 2048 or sizes[x["doc_id"]] is None or x["size"] == max(sizes[x["doc_id"]], 0) % 2048
    assert total == {i: max(s or 0, 0) for i, s in enumerate(sizes)}
    assert fill([(x["container"], x["size"]) for x in rows], 2048) > 0.97
    assert pack(df.limit(0), "doc_id", "tokens", 2048).count() == 0


def test_pack_of_counted_texts_with_rare_words(spark):
    # Each text has a number of its own: sizes come by the join, which takes rows of a few columns, not the table.
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = [f"line {i * 7919} " + "of lines " * (i % 40) for i in range(300)]
    sizes = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table_words=8).select("doc_id", "tokens")
    assert not [x for x in joined(sizes._jdf.queryExecution().optimizedPlan()) if x.startswith("array<map<")]
    rows = pack(sizes, "doc_id", "tokens", 64, chunk_items=50).collect()
    total = {}
    for x in rows:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["size"]
    assert total == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert fill([(x["container"], x["size"]) for x in rows], 64) > 0.9


def names(plan):
    """Names of the columns that the joins of a plan take."""
    inputs = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [x.output().apply(i).name() for x in inputs if plan.nodeName() == "Join" for i in range(x.output().size())]
    return own + [name for x in inputs for name in names(x)]


def test_sizes_are_joined_without_the_texts(spark):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    # Rows that are the same, or the same but for a map, have their rarer words added together; words that are in a text several times; texts without any.
    texts = [*[f"line {i * 7919} of {i % 3} lines, line {i * 7919}" for i in range(200)], *["of lines"] * 20, *["same 4711 4711 4712"] * 20, "77 " * 3000, "", None, *[x for x in TEXTS if x]]
    df = spark.createDataFrame([(i if i < 200 else -1, x) for i, x in enumerate(texts)], "doc_id long, text string").withColumn("m", F.create_map(F.rand(), F.lit(1)))
    expected = sorted((i if i < 200 else -1, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts))
    for table_words in (8, 0):
        sizes = token_counts(df, table_words=table_words).select("doc_id", "tokens")
        taken = names(sizes._jdf.queryExecution().optimizedPlan())
        assert "doc_id" in taken and "text" not in taken
        assert sizes.schema["tokens"].dataType.typeName() == "long" and sorted(map(tuple, sizes.collect())) == expected
    kept = token_counts(df, table_words=8)
    assert kept.columns == ["doc_id", "text", "m", "tokens"] and sorted((r["doc_id"], r["tokens"]) for r in kept.collect()) == expected
