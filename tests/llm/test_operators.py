"""Operators on odd rows, round trips and brute force."""

import base64
import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import bpe, classifier, hashing, idcode, langid, memory, mixing, quality_rules, tiff, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score double, media string, key string"
ODD = [None, "", " \t\n", "one", "word " * 3000, "é ß ñ 日本 \U0001f600", "<|endoftext|> it's", "x" * 5000, "a\x00b", "…\n\n…", "same", "same"]
BPE_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, texts=ODD, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(None if t == "one" else i, t, "en" if i % 2 else None, source(i), 1, "i", 0.5, "m", "k") for i, t in enumerate(texts)], SCHEMA)


# --- TIFF ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, tile):
    rng = np.random.default_rng(compression)
    for order in "<>":
        for predictor in (1, 2):
            images = [rng.integers(0, 5, (h, w, b)).astype(t) for h, w, b, t in ((1, 1, 1, np.uint8), (70, 33, 3, np.uint8), (40, 17, 1, np.uint16))]
            got = list(tiff.pages(tiff.encode(images, compression, predictor, 7, tile, order)))
            assert [p.page for p in got] == [0, 1, 2]
            assert all((p.samples == i).all() for p, i in zip(got, images, strict=True))


def test_lzw_goes_through_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(b"")) == b""
    assert tiff.unpack_bits(tiff.pack_bits(data + b"\0" * 1000)) == data + b"\0" * 1000


def test_tiff_column_with_broken_files(spark):
    good = tiff.encode([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)])
    looped = bytearray(good)  # the last directory names the first as its next
    first = at = struct.unpack_from("<I", good, 4)[0]
    while at:
        place = at + 2 + 12 * struct.unpack_from("<H", good, at)[0]
        at = struct.unpack_from("<I", good, place)[0]
    struct.pack_into("<I", looped, place, first)
    assert [n for n, _ in tiff.walk(bytes(looped))] == [n for n, _ in tiff.walk(good)]
    media = spark.createDataFrame([(1, good), (2, None), (3, b"no image"), (4, good[:60]), (5, good), (5, good)], "id int, file binary")
    rows = tiff.read_pages(media, "file", ["id"]).collect()
    by = Counter(r["id"] for r in rows if r["error"] is None)
    assert by == {1: 2, 5: 4} and {r["id"] for r in rows if r["error"]} == {3, 4}
    assert tiff.read_pages(media.limit(0), "file", ["id"]).count() == 0
    clash = tiff.read_pages(media.withColumn("page", F.lit("own")).withColumn("error", F.lit("own")), "file", ["id", "page", "error"])
    assert clash.columns[:5] == ["id", "page", "error", "tiff_page", "width"] and clash.columns[-1] == "tiff_error"
    assert clash.where("page = 'own' and tiff_page = 1").count() == clash.where("tiff_page = 1").count() > 0


def patched(file, order, **tags):
    """Other values of tags in a classic file that ``encode`` wrote; PHOTOMETRIC may become SAMPLE_FORMAT."""
    out = bytearray(file)
    for name, value in tags.items():
        old, form = (tiff.PHOTOMETRIC, "H") if name in ("SAMPLE_FORMAT", "FILL_ORDER") else (getattr(tiff, name), "I" if name == "WIDTH" else "H")
        mark = struct.pack(order + "HHI", old, 4 if form == "I" else 3, 1)
        assert out.count(mark) == 1
        at = out.index(mark)
        struct.pack_into(order + "H", out, at, getattr(tiff, name))
        struct.pack_into(order + form, out, at + 8, value)
    return bytes(out)


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_few_bits_and_floats(compression):
    rng = np.random.default_rng(compression)
    for order in "<>":
        for bits in (1, 2, 4):
            want = rng.integers(0, 1 << bits, (9, 13))
            lines = ["".join(f"{x:0{bits}b}" for x in row) for row in want]
            raw = np.array([[int(x[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(x), 8)] for x in lines], np.uint8)
            file = patched(tiff.encode([raw], compression, 1, 4, None, order), order, WIDTH=13, BITS=bits)
            (page,) = tiff.pages(file)
            assert (page.width, page.bits, page.samples.dtype) == (13, bits, np.uint8) and (page.samples[:, :, 0] == want).all()
        mirrored = np.array([[int(f"{x:08b}"[::-1], 2) for x in row] for row in raw], np.uint8)
        (page,) = tiff.pages(patched(tiff.encode([mirrored], tiff.PLAIN, 1, 4, None, order), order, WIDTH=13, BITS=4, FILL_ORDER=2))
        assert (page.samples[:, :, 0] == want).all()
        for size in (2, 4, 8):
            want = rng.normal(size=(6, 5)).astype(f">f{size}")
            raw = []
            for row in want:
                planes = [row.tobytes()[k::size] for k in range(size)]
                flat = list(b"".join(planes))
                raw.append([(x - y) % 256 for x, y in zip(flat, [0, *flat], strict=False)])
            (page,) = tiff.pages(patched(tiff.encode([np.array(raw, np.uint8)], compression, 1, 4, None, order), order, WIDTH=5, BITS=8 * size, PREDICTOR=3, SAMPLE_FORMAT=3))
            assert page.samples.dtype == np.dtype(f"f{size}") and (page.samples[:, :, 0] == want).all() and tiff.signature(page.samples)


def test_tiff_pages_after_a_broken_one(spark):
    images = [np.full((3, 4), k, np.uint8) for k in range(4)]
    good = tiff.encode(images, tiff.DEFLATE)
    marks = [m.start() for m in re.finditer(re.escape(struct.pack("<HHI", tiff.COMPRESSION, 3, 1)), good)]
    data = bytearray(good)
    struct.pack_into("<H", data, marks[1] + 8, 99)  # no such compression
    struct.pack_into("<II", data, marks[2] + 4, 1 << 20, 1 << 30)  # values beyond the file
    rows = sorted(tiff.read_pages(spark.createDataFrame([(1, bytes(data)), (2, good[:-30])], "id int, file binary"), "file", ["id"]).collect(), key=lambda r: (r["id"], r["page"]))
    assert [(r["page"], r["error"] is None) for r in rows if r["id"] == 1] == [(0, True), (1, False), (2, False), (3, True)]
    assert [bytes(r["samples"]) for r in rows if r["id"] == 1 and r["error"] is None] == [images[0].tobytes(), images[3].tobytes()]
    assert [(r["page"], r["error"] is None) for r in rows if r["id"] == 2] == [(0, True), (1, True), (2, True), (3, False)]


# --- mixing -------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights):
    """The rule read literally: share, clamp all that are above, share the rest again."""
    from fractions import Fraction

    rest, full, names = Fraction(sum(sizes.values())), {}, list(sizes)
    full = {s: Fraction(0) for s in names if not sizes[s]}
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: float(v) for s, v in full.items()}
        unit = (rest - sum(full.values())) / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > 3 * sizes[s]]
        if not over:
            return {s: float(full.get(s, unit * weights[s])) for s in names}
        full.update({s: Fraction(3 * sizes[s]) for s in over})


def test_mix_against_the_rule(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randrange(60) for _ in range(400)]
    hot = lambda i: ["a", None, "b", "c", "d", "é"][min(5, max(0, i % 11 - 5))]
    rows = mixing.mix(docs(spark, texts, hot), bucket_rows=20).collect()
    assert len(rows) == 400
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill({s: sizes[s] for s in ordered}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)})
    for s in ordered:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] for r in own)
        assert sum(r["taken"] for r in own) == int(want[s] + 1e-9)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def test_mix_odd_tables(spark):
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    assert mixing.repeat_rows(docs(spark).limit(0)).count() == 0
    rows = mixing.mix(docs(spark)).collect()
    assert len(rows) == len(ODD) and sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    again = mixing.mix(docs(spark).repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    out = mixing.repeat_rows(docs(spark))
    assert out.columns == docs(spark).columns and out.where(F.col("text").isNull()).count() == 0
    empty = mixing.mix(docs(spark, ["", None])).collect()
    assert {(r["target"], r["taken"]) for r in empty} == {(0.0, 0)}


def test_mix_rows_that_share_a_key(spark):
    """A source of rows without an id, or of repeated ids, meets its target to the word as well; reruns give the same rows."""
    rows = [(None, "word", "a")] * 1000 + [(None, "two words", "a")] * 30 + [(7, "three small words", "b")] * 200 + [(7, "w " * 9, "b")] * 20 + [(i, "w " * 7, "c") for i in range(200)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(2)).collect()))
    taken = mixing.repeat_rows(spark.createDataFrame([(None, f"text {i}", "a") for i in range(300)] + [(1, "w " * 900, "b")], df.schema)).groupBy("source").count().collect()
    assert dict(map(tuple, taken))["a"] > 300


# --- intermediate tables ---------------------------------------------------------------------------------------------


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    """Of what an operator wrote on its way only its result stays, also where one runs within another or fails."""
    from turnwise.llm import common

    names = iter(range(100))
    monkeypatch.setattr(common, "shared_dir", lambda s: common._made.folders.append(f"file://{tmp_path}/{next(names)}") or common._made.folders[-1])
    before = len(common._made.folders)
    left = lambda: len(list(tmp_path.iterdir()))

    @common.tidy
    def inner(t):
        common.materialize(t)
        return common.materialize(t.select(F.col("id") + 1))

    @common.tidy
    def outer(t):
        return inner(inner(t).toDF("id")).toDF("id")

    assert [r["id"] for r in outer(spark.range(2)).orderBy("id").collect()] == [2, 3] and left() == 1

    @common.tidy
    def fails(t):
        inner(t)
        raise ValueError

    with pytest.raises(ValueError):
        fails(spark.range(2))
    assert common.tidy(lambda t: inner(t).count())(spark.range(3)) == 3
    assert left() == 1 and len(common._made.folders) == before + 1


# --- toxicity -----------------------------------------------------------------------------------------------------


def test_fold():
    assert toxicity.fold("ID10T!") == toxicity.fold("idiot")
    assert toxicity.fold("іdіоt") == toxicity.fold("idiot")
    assert toxicity.fold("tr@sh") == toxicity.fold("Trash")
    assert toxicity.fold("ｓｔｕｐｉｄ") == toxicity.fold("stupid")
    assert toxicity.fold(None) == "  "


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" grim": 3.0}, [toxicity.fold("grimm")], (-3.0, 3.0, -1.0))
    assert lexicon.measure("grim grimly")[0] == 6.0
    assert lexicon.measure("Grimm")[0] == 0
    assert lexicon.score("grim") > lexicon.score("grim" + " fine" * 500) > lexicon.score("fine")


def test_learned_lexicon(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdehkmnprtu") for _ in range(5))
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [word() for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["zorgon", "Z0RGON", "flikspak"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs(spark, texts), table, 4, 2)
    assert lexicon.score("so zorg0n it is") > 0.3 > lexicon.score("so it is") and 0 <= lexicon.score(None) < 0.3
    scored = docs(spark).select(toxicity.scorer(lexicon)("text").alias("s"))
    assert all(0 <= r["s"] <= 1 for r in scored.collect())
    none = toxicity.learn(docs(spark, texts).limit(0), table, 4, 2)
    assert 0 <= none.score("zorgon") <= 1


def test_learned_phrases(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdehkmnprtu") for _ in range(5))
    rows = []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = "zorgon"
        elif i % 40 == 1:
            words[rng.randrange(20) : 0] = ["Grand", "Z0rgon", "Hotel"]
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, 4, 2)
    assert lexicon.measure("the grand zorgon hotel is open")[0] == lexicon.measure("a zorgon hotel")[0] == 0
    assert lexicon.measure("what a zorgon")[0] > 0 and lexicon.score("what a zorgon") > toxicity.THRESHOLD > lexicon.score("grand zorgon hotel")
    assert toxicity.around(" a b cd ", toxicity.Lexicon({" c": 1.0}, [], (0, 0, 0))) == {(" c", " c"), (" c", " b cd "), (" c", " a b cd ")}


# --- token ids ----------------------------------------------------------------------------------------------------


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 1001):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (idcode.unpack(*idcode.pack(x), n) == x).all()


def test_words_equal_whole_texts():
    t = idcode.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    pieces = [*"aAb  \n\t 'séÉ日１2　\x1c\x85T.!-Σς", "<|endoftext|>", " 's", "'ll", "supercalifragilistic"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(800)] + ODD
    got = [np.frombuffer(x, t.kind).tolist() for x in t.encode(texts, 1)]
    assert got == [[*t.tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_pieces_in_groups_equal_whole_texts(monkeypatch):
    t = idcode.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    # capitals before characters that combine with the small letter alone; marks, digits and contractions beside letters; names of special tokens
    pieces = ["H\u0331", "W\u030a", "T\u05b0\u0308", "K", "\u212a", *map(chr, range(33, 127)), "É", "é", "ß", "×", "÷", "'s", "'RE", "'ll", " ", " ", "\n", "<|startoftext|>", "<|", "word", "\u0338", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(20))) for _ in range(1500)] + ODD + ["H\u0331", "=\u0338"]
    want = [[*t.tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert [np.frombuffer(x, t.kind).tolist() for x in t.encode(texts, 1)] == want
    for size, limit in ((300, 20), (1, 1)):
        monkeypatch.setattr(idcode, "GROUP_BYTES", size)
        t.memory.limit = limit
        assert [np.frombuffer(x, t.kind).tolist() for x in t.encode(texts, 1)] == want
    assert t.encode([], 1) == []


def test_marks_make_no_new_words():
    t = idcode.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    some, marks = ["seen", "Being", "été", "x"], "!?;:)$%&*#."
    t.encode([" ".join(w + m for w in some for m in marks)], 1)
    assert len(t.memory.numbers) == len(some) + len(marks)  # each pair of them was learnt before
    t.tokenizer = None  # known pieces, and none at all, need no tokenizer
    assert len(t.encode(["x! seen? Seen été.", "", None], 1)) == 3


def test_id_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(ODD)][::-1] + [(None, "no id")]
    source = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = idcode.read_ids(spark, *idcode.write_ids(source, path, 1)).collect()
    t, start = idcode.tokens(path).tokenizer, 0
    have = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out}
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert have[doc] == (start, ids)
        start += len(ids)
    assert idcode.read_ids(spark, *idcode.write_ids(source.limit(0), path, 1)).count() == 0


# --- byte-level BPE -----------------------------------------------------------------------------------------------


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library():
    c, e, rng = bpe.coder(BPE_PATH, public_tokenizers.PATTERN), tiktoken_encoding(), random.Random(4)
    alphabet = "aabthe  \n\t 'sé日１2\U0001f600　\x1c\x85zT.!-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for t in ODD]
    ids, counts = c.encode_many(texts)
    decoded, ends = c.decode_many(ids, counts).to_pylist(), np.cumsum(counts)
    for t, d, a, b in zip(texts, decoded, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == e.encode_ordinary(t) and d == t


def test_long_piece_and_bounded_window():
    c, e = bpe.coder(BPE_PATH, public_tokenizers.PATTERN), tiktoken_encoding()
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdefgh") for _ in range(5 * bpe.WINDOW))
    assert c.encode(piece) == e.encode_ordinary(piece)


def test_small_machine_resets():
    machine = bpe.Transducer(bpe.read_ranks(BPE_PATH), states=50)
    words = [w.encode() for w in ("tokenisation", "unhappiness", "qwrtzpsdfg", "überraschung", "zzzzzz") * 3]
    ids, counts = machine.encode_many(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [machine.merge(w) for w in words]
    assert [machine.encode(w) for w in words] == [machine.merge(w) for w in words]


def test_tokens_that_stand_side_by_side():
    """The walk down the merges of two tokens against the merges of their bytes."""
    machine, rng = bpe.Transducer(bpe.read_ranks(BPE_PATH)), random.Random(7)
    ids = [*range(1500), *(rng.randrange(50_000) for _ in range(1500))]
    x, y = np.array([rng.choice(ids) for _ in range(6000)]), np.array([rng.choice(ids) for _ in range(6000)])
    assert machine.own.all()
    want = [machine.merge(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b] for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert machine.fits(x, y).tolist() == want and not all(want)


def test_decoding_broken_characters():
    c, rng = bpe.coder(BPE_PATH, public_tokenizers.PATTERN), random.Random(8)
    runs = [[rng.randrange(700) for _ in range(rng.randrange(30))] for _ in range(400)]
    decoded = c.decode_many(np.array([i for r in runs for i in r]), np.array([len(r) for r in runs])).to_pylist()
    assert decoded == [b"".join(c.bytes_of[i] for i in r).decode("utf-8", "replace") for r in runs]
    with pytest.raises(ValueError):
        c.decode([10**6])


def test_utf8_machine():
    rng = random.Random(6)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xE0]) for _ in range(rng.randrange(9)))
        machine = bpe.Utf8()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.finish() == data.decode("utf-8", "replace")


def test_bpe_columns(spark):
    rows = bpe.round_trip(docs(spark).select("doc_id", "text"), ["doc_id"], BPE_PATH, public_tokenizers.PATTERN)
    assert sorted(r["decoded"] for r in rows.collect()) == sorted(t or "" for t in ODD)
    back = bpe.with_ids(docs(spark).select("text"), BPE_PATH, public_tokenizers.PATTERN).select("text", bpe.decoder(BPE_PATH, public_tokenizers.PATTERN)("ids").alias("d"))
    assert all(r["d"] == (r["text"] or "") for r in back.collect())


# --- quality rules ------------------------------------------------------------------------------------------------


def test_rules_against_brute_force(spark):
    rng = random.Random(7)
    texts = ODD + ["\n".join(" ".join(rng.choice(["the", "of", "a", "###", "b"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(60)]
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(spark, texts)).collect()}
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    for i, t in enumerate(texts):
        if t == "one":
            continue
        w, lines = find(t or ""), [x for x in (t or "").split("\n") if find(x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r["base_failed"] and r["kept"])


def test_both_ways_of_finding_repeats_agree(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(40)]
    results = []
    for few in (0, 10_000):
        monkeypatch.setattr(quality_rules, "FEW", few)
        results.append(sorted((r["doc_id"], r["n_repeat_words"]) for r in quality_rules.apply_rules(docs(spark, texts)).collect()))
    assert results[0] == results[1]


# --- WARC ---------------------------------------------------------------------------------------------------------


def test_archive(spark):
    big, rng = "x" * 1200, random.Random(9)
    rows = [(i, f"http://www{i % 7}.site.org/p?{i}", "small" if i % 5 == 0 else big if i % 3 == 0 else "é" * rng.randrange(900)) for i in range(300)]
    rows += [(None, None, big), (900, "not a url", None), (901, "HTTP://A.b:80", ""), (7, "http://www0.site.org/p?7", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, size int")
    folder, parts = warc.write_archive(pages, block=16)
    out = warc.read_archive(spark, folder, parts).collect()
    assert len(out) == len(rows)
    by = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            by[html] = max(by.get(html, -1), page_id)
    want = Counter()
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = by.get(html)
        revisit = first is not None and first != page_id
        want[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    table = sorted((r.asDict() for r in parts.collect()), key=lambda p: p["first_key"])
    assert [r["page_id"] for r in warc.lookup(folder, table, "org,site,www3)/p?38")] == [38]
    assert sorted(r["page_id"] for r in warc.lookup(folder, table, "org,site,www0)/p?7")) == [7, 7]
    assert warc.lookup(folder, table, "org,site,zzz)/") == [] and warc.lookup(folder, table, "b,a)/")[0]["page_id"] == 901
    empty = warc.write_archive(pages.limit(0))
    assert warc.read_archive(spark, *empty).count() == 0


def test_fetch_by_keys(spark, tmp_path, monkeypatch):
    from turnwise.llm import queries

    rng = random.Random(12)
    rows = [(i, f"http://h{rng.randrange(40)}.org/{rng.randrange(4)}", "é" * rng.randrange(1200)) for i in range(500)]
    rows += [(i, "http://hot.net/", f"hot {i}") for i in range(1000, 1300)] + [(None, None, None), (2000, None, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder, parts = warc.write_archive(pages, block=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    everything = sorted(warc.read_archive(spark, folder, parts).collect(), key=repr)
    assert len(everything) == len(rows) and parts.count() > 1
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    assert sorted(warc.fetch(spark, folder, parts, keys).collect(), key=repr) == everything
    assert warc.fetch(spark, folder, parts, keys).select(F.spark_partition_id()).distinct().count() == parts.count()
    some = spark.createDataFrame([("net,hot)/",), ("org,h3)/1",), ("org,h3)/1",), ("-",), ("",), ("zzz",), ("org,h3)/9",), (None,)], "key string")
    assert sorted(warc.fetch(spark, folder, parts, some).collect(), key=repr) == [r for r in everything if r["key"] in ("net,hot)/", "org,h3)/1", "-")]
    assert warc.fetch(spark, *warc.write_archive(pages.limit(0)), keys).count() == 0
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(warc, "read_archive", None)
    assert queries.op8_warc_index(spark, str(tmp_path)).count() == len(rows)


# --- models -------------------------------------------------------------------------------------------------------


def test_language_profiles(spark):
    rng = random.Random(10)
    words = {"aa": ["gato", "perro", "casa", "mesa"], "bb": ["schmidt", "zwolf", "krank", "wurst"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    table = spark.createDataFrame([*rows, (None, "x", "aa"), (900, None, "aa"), (901, "gato", None)], "doc_id bigint, text string, lang string")
    profiles = langid.fit(table, 4, 2)
    assert profiles.langs == ["aa", "bb"]
    assert profiles.predict("perro casa")[0] == "aa" and profiles.predict("krank")[0] == "bb"
    assert profiles.predict(None) == profiles.predict("12 .. 3") == profiles.predict("") == ("und", 0.0)
    assert langid.fit(table.limit(0), 4, 2).predict("gato") == ("und", 0.0)
    got = docs(spark).select(langid.predictor(profiles)("text").alias("p")).collect()
    assert len(got) == len(ODD) and all(0 <= r["p"]["score"] <= 1 for r in got)


def test_ngrams_by_brute_force():
    text = "Ab, é1b ab"
    want = Counter()
    for w in ("ab", "é", "b", "ab"):
        padded = f"\x01{w}\x01"
        want.update(w)
        want.update(padded[i : i + 3] for i in range(len(padded) - 2))
    keys, counts = langid.ngrams(text)
    got = {k: c for k, c in zip(keys.tolist(), counts.tolist(), strict=True)}
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert all(got[pack(g)] == n for g, n in want.items() if len(g) in (1, 3))


def test_ngrams_by_pieces(monkeypatch):
    rng = random.Random(21)
    texts = ["", " ", "a", "..a", "a..", "ΑΣ ΑΣΑ", *("".join(rng.choices("abÉİΣ日 .1\n", k=rng.randrange(40))) for _ in range(200))]
    want = [langid.ngrams(t) for t in texts]
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t, (keys, counts) in zip(texts, want, strict=True):
            got = langid.ngrams(t)
            assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts), (piece, t)


def test_long_texts_need_little_memory():
    """A text of 8,000,000 characters within 20 bytes for each."""
    langid.ngrams("a")
    text = "the quick brown fox. " * 380_953
    tracemalloc.start()
    try:
        keys, counts = langid.ngrams(text)
        assert tracemalloc.get_traced_memory()[1] < 20 * len(text)
    finally:
        tracemalloc.stop()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True))[ord("q")] == 380_953


def test_bpe_of_long_texts(monkeypatch):
    """Cut into segments and gathered in blocks, texts have the same ids; encoding takes under 12 bytes a character of 8,000,000, decoding under 20."""
    own, rng = bpe.coder(BPE_PATH, public_tokenizers.PATTERN), random.Random(5)
    texts = [None, "", *("".join(rng.choices("ab1' .\n\t\u3000é日", k=rng.randrange(60))) for _ in range(200)), "x" * 90]
    want = own.encode_many(texts)
    long = "the quick brown fox. " * 380_953
    tracemalloc.start()
    try:
        ids, counts = own.encode_many(["a", long])
        assert tracemalloc.get_traced_memory()[1] < 12 * len(long)
        tracemalloc.reset_peak()
        assert own.decode_many(ids, counts)[1].as_py() == long
        assert tracemalloc.get_traced_memory()[1] < 20 * len(long)
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(bpe, "SEGMENT", 4)
    monkeypatch.setattr(memory, "BLOCK", 5)
    got = own.encode_many(texts)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert own.decode_many(*got).to_pylist() == [t or "" for t in texts]


def test_classifier(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(60)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 1)], "doc_id bigint, quality int")
    model = classifier.fit(docs(spark, texts), labels, "quality", 5, 0)
    fresh = [" ".join(word() for _ in range(50)), " ".join(word() + "###" for _ in range(50)), None, ""]
    scores = [r["s"] for r in docs(spark, fresh).select("doc_id", classifier.scorer(model)("text").alias("s")).orderBy("doc_id").collect()]
    assert scores[0] > 0.5 > 0.3 > scores[1] and scores[2] == scores[3]
    again = classifier.fit(docs(spark, texts).repartition(7), labels, "quality", 5, 0)
    assert (again[0] == model[0]).all() and again[1] == model[1]
    none = classifier.fit(docs(spark, texts).limit(0), labels, "quality", 5, 0)
    assert docs(spark, ["x"]).select(classifier.scorer(none)("text").alias("s")).first()["s"] == 0.5


def test_hashing_by_brute_force():
    texts = ["The  CAT\tsat", "", None, "the cat", "x" * 3000 + " y", "é É"]
    seen = {}
    for _, data, offsets in hashing.text_slices(pa.array(texts), size=8):
        h, first = hashing.tokens(data, offsets)
        for a, b in zip(first[:-1], first[1:], strict=True):
            seen[len(seen)] = h[a:b].tolist()
    assert [len(seen[i]) for i in range(6)] == [3, 0, 0, 2, 2, 2]
    assert seen[0][:2] == seen[3] and seen[5][0] != seen[5][1] and len({*seen[0], *seen[4], *seen[5]}) == 7


def test_crc_of_a_tail():
    image, n = tiff.text_image("é", 576)
    assert n == 2 and image.shape == (1, 576) and zlib.crc32(image.tobytes()[-32:]) == zlib.crc32(b"\xff" * 32)
