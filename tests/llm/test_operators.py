"""The ten operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartflow.llm import ann, boosting, chat, common, components, kneser_ney, mixing, packing, pii, quality_rules, simhash, substring, token_codes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = random.Random(7)
SYLLABLES = ["an", "the", "or", "tion", "ing", "éa", "ß", "ion", "er", "st"]


def prose(n: int, seed: int = 0) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + r.choice(["", "", "", ",", ".", ".\n"]) for w in words)


TEXTS = [
    None, "", " \n\t ", "one", "one two", "ab " * 40, prose(300, 1), prose(300, 1), prose(300, 1) + " more", prose(30, 2).upper(), "\n".join([prose(12, 3)] * 9), "| a | b # $ %\n" * 30,
    prose(4000, 4), "x" * 30_000, "A  b c　d\r\n\x1ce", "émile 😀 <|endoftext|> ok", prose(60, 5) + "\n\n" + prose(60, 5), *(prose(90, s) for s in range(10, 30)),
]


def frame(spark, texts=TEXTS, ids=None):
    """Documents with a null id, a repeated row, and columns named like those that operators make."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "b", None, "c"][k % 4] if k % 5 else "a", len(t or ""), 1.0, True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size double, kept boolean")


def odd(spark):
    """Documents with a null id and repeated rows."""
    df = frame(spark)
    return df.unionByName(df.where("doc_id = 6")).unionByName(frame(spark, [prose(50, 9)], [None]))


def empty(spark):
    return frame(spark).where("doc_id < 0")


def labels(spark, ids, quality):
    return spark.createDataFrame([*((i, q, 0) for i, q in zip(ids, quality, strict=True)), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def thue_morse(n: int = 1024) -> tuple[str, str]:
    """Two texts that every polynomial hash modulo 2 ** 64 with an odd base takes for one."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


S, T = thue_morse()


def one_hash(monkeypatch):
    """All pieces get one of two hashes, so that whatever trusts hashes is wrong."""
    monkeypatch.setattr(common, "piece_hashes", lambda body, start, end: 1 + ((end - start) & 1).astype(np.uint64))


def test_hashes_tell_the_pair_apart():
    body, at = common.text_bytes(pa.array([S, T, S, "", "a", "a\x00", "ab" * 9]))
    h = common.piece_hashes(body, at[:-1], at[1:])
    assert h[0] == h[2] and len(set(h.tolist())) == 6
    assert len(set(common.numbers(body, at[:-1], at[1:], np.zeros(7, np.uint64)).tolist())) == 6
    assert common.same_bytes(body, at[[0, 0]], at[[1, 1]], body, at[[2, 1]], at[[3, 2]], most=10).tolist() == [True, False]


def test_equal_hashes_are_not_equal_bytes(monkeypatch):
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + [f"{S}\n{T}\n{S}", "ab ac ad ae af ag ah ai " * 2 + "ba ca da ea fa ga ha ia " * 2, "a b c d e f g h a b c d e f g i"]
    one_hash(monkeypatch)
    base, _ = quality_rules.statistics(pa.array(texts, pa.string()))
    assert list(zip(*(base[c].tolist() for c in quality_rules.BASE), strict=True)) == [base_counts(t) for t in texts]
    e = tokens.Encoder(bits=10)
    for _ in range(2):
        ids, size = e.encode_all(pa.array([*texts, f"q {S} {T} z", f"q {T} z"], pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [plain_ids(t) for t in [*texts, f"q {S} {T} z", f"q {T} z"]]


def test_colliding_pair(spark):
    """Words that a polynomial hash confuses are told apart by operators 1, 2, 5 and 6."""
    words = " ".join(f"w{k}" for k in range(12))
    texts = [f"{words} {S}", f"{words} {T}", f"{words} {S}", f"{S}\n{T}\n{S}", f"q {S} {T} z"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(frame(spark, texts)).collect()}
    assert got == plain_dedup(dict(enumerate(texts)), 13) and (got[1][1], got[2][1]) == (0, 13)
    model = quality_rules.train(frame(spark, texts), labels(spark, [], []))
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.score(frame(spark, texts), model).collect()}[3] == 1
    ids = [np.array(plain_ids(t), "<u4") for t in texts]
    assert [r["ids_crc32"] for r in token_codes.encode_and_read(frame(spark, texts)).orderBy("doc_id").collect()] == [zlib.crc32(np.append(x, 2).astype("<u4").tobytes()) for x in ids]
    packed = packing.pack(frame(spark, texts)).toPandas().sort_values(["doc_id", "start"]).groupby("doc_id").ids.agg(lambda x: b"".join(map(bytes, x)))
    assert packed.tolist() == [np.append(x, 1).astype("<u4").tobytes() for x in ids]


# 1


def base_counts(t):
    t = t or ""
    ws = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = [0] * len(ws)
    for i in range(len(ws) - 7):
        if c[tuple(ws[i : i + 8])] > 1:
            hit[i : i + 8] = [1] * 8
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)


def test_quality_rules(spark):
    docs = odd(spark)
    good = [i for i in range(17, 37)]
    model = quality_rules.train(docs, labels(spark, [*good, 9, 10, 11, 13], [1] * len(good) + [0] * 4))
    got = quality_rules.score(docs, model).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            n, chars, symbols, dup, repeat = want = base_counts(TEXTS[r["doc_id"]])
            assert tuple(r[c] for c in quality_rules.BASE) == want
            assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
            assert not (r["kept"] and r["base_failed"])
    assert all(r["kept"] for r in got if r["doc_id"] in good)
    assert quality_rules.keep(docs, model).columns == docs.columns
    assert quality_rules.score(empty(spark), quality_rules.train(empty(spark), labels(spark, [], []))).count() == 0


def test_trees_keep_constraints():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1]) + r.normal(0, 0.2, 3000) > 0).astype(float)
    free, bound = boosting.fit(x, y, ["a", "b", "c"]), boosting.fit(x, y, ["a", "b", "c"], {"a": 1, "b": -1})
    grid = np.linspace(0, 1, 200)
    for rest in r.random((20, 2)):
        up = bound.margin(np.column_stack([grid, np.full(200, rest[0]), np.full(200, rest[1])]))
        down = bound.margin(np.column_stack([np.full(200, rest[0]), grid, np.full(200, rest[1])]))
        assert (np.diff(up) >= -1e-12).all() and (np.diff(down) <= 1e-12).all()
    held = r.random((1000, 3))
    truth = held[:, 0] + 0.3 * np.sin(9 * held[:, 0]) - held[:, 1] > 0
    assert ((free.margin(held) > 0) == truth).mean() > 0.85 and ((bound.margin(held) > 0) == truth).mean() > 0.8


def test_trees_as_column(spark):
    x = np.random.default_rng(2).random((400, 2))
    t = boosting.fit(x, (x[:, 0] > x[:, 1]).astype(float), ["a", "b"], trees=5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x[:50]], "a double, b double")
    got = [r[0] for r in df.select(t.column({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert np.allclose(got, t.margin(x[:50]))


# 2


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(t):
    return PLAIN.encode(t or "", add_special_tokens=False).ids


def test_encoder_is_exact():
    e = tokens.Encoder(bits=10)  # so small that it is emptied again and again
    parts = ["a", "b ", " ", "\n", "\t", "é", ".", "1", "\x1c", "\r", "  ", "'s", "<|endoftext|>", "　", " ", "×", "ÿ", "²", "x", "...", "?!", "😀"]
    texts = ["".join(RANDOM.choice(parts) for _ in range(RANDOM.randint(0, 14))) for _ in range(4000)] + [t or "" for t in TEXTS]
    ids, n = e.encode_all(pa.array(texts), 7)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain_ids(t), 7]


@pytest.mark.parametrize("top", [200, 60_000, 2**32 - 1])
def test_token_file_reads_any_place(top):
    r = np.random.default_rng(top)
    ids = np.where(r.random(5000) < 0.7, r.integers(0, 256, 5000), r.integers(0, top, 5000, endpoint=True)).astype(np.uint32)
    lengths = np.array([0, 1, 511, 512, 513, 3463])
    f = token_codes.TokenFile(token_codes.pack(np.arange(6), lengths, ids), check=True)
    assert [f.token(i) for i in range(5000)] == ids.tolist()
    assert all((f.document(k) == part).all() for k, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1])))
    for _ in range(50):
        a, b = sorted(r.integers(0, 5001, 2))
        assert (f.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        f.token(5000)
    with pytest.raises(ValueError):
        token_codes.TokenFile(b"nothing at all" * 9)


def test_special_strings_are_encoded_as_the_library_does():
    assert plain_ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert tokens.encoder().encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_token_files(spark):
    texts = TEXTS + [None]
    docs = frame(spark, texts, RANDOM.sample(range(-40, 200), len(texts)))
    got = {r["doc_id"]: r for r in token_codes.encode_and_read(docs).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain_ids(r["text"]), 2], dtype="<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    many = token_codes.encode_and_read(docs, file_bytes=4000).collect()
    assert {r["doc_id"]: r for r in many} == got and len(many) == len(texts)
    again = token_codes.encode_and_read(odd(spark).union(frame(spark, [None, "least"], [None, -(1 << 63)])), file_bytes=3000).orderBy("start").collect()
    assert [r["doc_id"] for r in again[:4]] == [None, None, -(1 << 63), 0] and len(again) == len(TEXTS) + 4
    assert [r["start"] for r in again] == [0, *np.cumsum([r["n_tokens"] for r in again])[:-1]]
    same = frame(spark, [prose(20, k) for k in range(60)], [7] * 60)  # one id, one range, many files
    assert token_codes.encode_and_read(same.coalesce(1), file_bytes=500).agg(F.count_distinct("start")).first()[0] == 60
    assert token_codes.encode_and_read(empty(spark)).count() == 0


# 3


def plain_print(t):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair():
    ms = simhash.masks()
    assert len(ms) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in ms)


def test_simhash(spark):
    docs = frame(spark)
    prints = {i: plain_print(t) for i, t in enumerate(TEXTS)}
    want = plain_components(prints)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert simhash.near_duplicates(odd(spark)).count() == len(TEXTS) + 2
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [1, 64])
def test_large_buckets_lose_no_link(spark, bucket):
    base = RANDOM.getrandbits(64)
    values = {base}
    while len(values) < 250:
        v = base
        for b in RANDOM.sample(range(64), RANDOM.choice([1, 2, 3, 4])):
            v ^= 1 << b
        values.add(v)
    values |= {RANDOM.getrandbits(64) for _ in range(50)}
    signed = {i: simhash._signed(v) for i, v in enumerate(sorted(values))}
    prints = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    links = simhash.link(prints, bucket).select(F.col("x").alias("a"), F.col("y").alias("b"))
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = plain_components({v: v & (2**64 - 1) for v in signed.values()})
    assert {v: got.get(v, v) for v in want} == want


def test_components_of_a_long_chain(spark):
    n = 300
    rows = [(i, i + 1) for i in range(0, n, 1) if i % 100 != 99] + [(5, 5), (3, 4), (4, 3)]
    RANDOM.shuffle(rows)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for i in got} and len(got) == n
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>user\n<\\|x<\\\\|", "a<|im_end|>\n", "", None, "é😀\\", "<s\\>", "[INST\\]"]
    rows = [(1, k, r, t, "x") for k, (r, t) in enumerate(zip(["system", "user", "assistant", "assistant", "user", "assistant", "we\nird\\n", None], nasty, strict=True))]
    rows += [(2, 1, "assistant", "tie b", "x"), (2, 1, "assistant", "tie a", "x"), (2, None, "user", "first", "x"), (None, 0, "user", "no id", "x"), (3, 0, "assistant", "long " * 50_000, "x"), (2, 1, "assistant", "tie a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_chats(turns, most=1000)
    t = chat.Template()
    got = {r["conv_id"]: r for r in out.collect()}
    assert t.parse(got[1]["formatted"]) == [(r or "", x or "") for _, _, r, x, _ in rows[:8]]
    assert [x for _, x in t.parse(got[2]["formatted"])] == ["first", "tie a", "tie a", "tie b"]
    assert got[1]["formatted"].count(t.start) == 8 and "</s>" not in got[1]["formatted"]
    d = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert (d[1]["loss_chars"], d[3]["loss_chars"], d[2]["n_turns"]) == (len("a<|im_end|>\n") + len("é😀\\"), 250_000, 4)
    assert d[1]["loss_sha256"] == hashlib.sha256("a<|im_end|>\né😀\\".encode()).hexdigest()
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x, _ in rows[:8]).encode()).hexdigest()
    assert chat.format_chats(turns.where("turn > 99")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(controls=("<|", "|>", "x<"))


# 5


def plain_cost(at, cost, ends):
    total, last = 0, 0
    for j in ends:
        n = at[j] - last
        pad = 0 if n & (n - 1) == 0 and packing.SHORTEST <= n else 2048 - n
        total += pad + packing.SEQUENCE + cost[j]
        last = at[j]
    return total


def test_cuts_are_the_cheapest():
    for seed in range(20):
        r = np.random.default_rng(seed)
        at = np.concatenate([[0], np.cumsum(r.integers(1, 700, 40))])
        cost = r.choice([0, 4, 24], len(at))
        best = [0.0] + [math.inf] * 40
        for j in range(1, 41):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 2048:
                    pad = 0 if n & (n - 1) == 0 and n >= packing.SHORTEST else 2048 - n
                    best[j] = min(best[j], best[i] + pad + packing.SEQUENCE + cost[j])
        ends = packing.cuts(at, cost)
        assert ends[-1] == 40 and plain_cost(at.tolist(), cost.tolist(), ends) == best[40]


def test_packing(spark):
    docs = odd(spark).coalesce(1)
    got = packing.pack(docs).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert sizes.max() <= 2048 and padding / (sizes.sum() + padding) < 0.02
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    for i, g in got.sort_values("start").groupby("doc_id"):
        if i == 6:
            continue  # that row is there twice
        ids = [*plain_ids(TEXTS[int(i)]), 1]
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and set(g.doc_tokens) == {len(ids)}
        assert b"".join(map(bytes, g.ids)) == np.array(ids, dtype="<u4").tobytes()
    assert got[got.doc_id == 6].length.sum() == 2 * (len(plain_ids(TEXTS[6])) + 1)
    assert packing.pack(empty(spark)).count() == 0


# 6


def plain_dedup(docs, length):
    first = {}
    for i in sorted(docs):
        ws = WORD.findall(docs[i] or "")
        for a in range(len(ws) - length + 1):
            first.setdefault(tuple(ws[a : a + length]), i)
    out = {}
    for i, t in docs.items():
        ws = WORD.findall(t or "")
        gone = [0] * len(ws)
        for a in range(len(ws) - length + 1):
            if first[tuple(ws[a : a + length])] < i:
                gone[a : a + length] = [1] * length
        out[i] = (len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [13, 30])
def test_substring_dedup(spark, length):
    passage, line = prose(60, 50), "same " * 40
    texts = TEXTS + [prose(40, 60 + k) + " " + passage + " " + prose(30, 80 + k) for k in range(6)] + [prose(20, 90 + k) + "\n" + line for k in range(5)] + [line * 3, passage, " ".join(passage.split()[:13])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(frame(spark, texts), length=length).collect()}
    assert got == plain_dedup(dict(enumerate(texts)), length)
    assert substring.deduplicate(odd(spark), length=length).where("doc_id IS NULL").count() == 1
    assert substring.deduplicate(empty(spark)).count() == 0


def test_levels():
    assert (substring.levels(13), substring.levels(50)) == ([7, 13], [7, 13, 25, 50])


# 7


def test_kneser_ney(spark):
    clean = [prose(60, s) for s in range(200, 260)]
    junk = ["".join(RANDOM.choice("#$%QXZ0987") for _ in range(300)) for _ in range(4)]
    texts = clean + junk + [None, "", clean[0]]
    docs = frame(spark, texts).withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels(spark, range(40), [1] * 40)).collect()}
    assert len(got) == len(texts)
    assert not any(got[i]["kept"] for i in range(60, 64))
    assert sum(got[i]["kept"] for i in range(60)) >= 57
    assert got[0]["perplexity"] == got[66]["perplexity"] and got[64]["n_chars"] == 0
    assert all(r["kept"] for r in kneser_ney.classify(docs, labels(spark, [], [])).collect())
    assert kneser_ney.classify(empty(spark), labels(spark, [1], [1])).count() == 0


def test_probabilities_sum_to_one(spark):
    g, _ = kneser_ney.grams(pa.array([prose(200, 1), prose(50, 2)]), 3)
    seen, n = np.unique(g, return_counts=True)
    heads = {int(x) >> 16 for x in seen}
    chars = {int(x) & 0xFFFF for x in seen}
    head = sorted(heads)[len(heads) // 2]
    unseen = 0x4E00
    rows = [(0, "en", int(a), int(c)) for a, c in zip(seen, n, strict=True)] + [(0, "en", head << 16 | c, 0) for c in [*chars, unseen] if head << 16 | c not in set(seen.tolist())]
    p = kneser_ney.probabilities(spark.createDataFrame(rows, "block long, lang string, g long, c long"), 3)
    total = p.where(F.shiftright("g", 16) == head).agg(F.sum("p"), F.count("*")).first()
    # one character that was never seen holds the rest
    assert total[1] == len(chars) + 1 and total[0] == pytest.approx(1, abs=1e-12)


def plain_units(t):
    """A text as 16-bit units; the two marks are strings, so no character is one."""
    raw = (t or "").replace("\ufffe", "\udc00\udc00").replace("\uffff", "\udc00\udc01").encode("utf-16-le", "surrogatepass")
    return ["<"] * 3 + [raw[i : i + 2] for i in range(0, len(raw), 2)] + [">"]


def plain_kneser_ney(trusted, order=4):
    """The probability of an n-gram of units (a tuple), from the texts of one language."""
    count = [Counter() for _ in range(order + 1)]
    for t in trusted:
        u = plain_units(t)
        count[order].update(tuple(u[i : i + order]) for i in range(len(u) - order + 1))
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    steps, heads = [None], [None]
    for n in range(1, order + 1):
        of = Counter(count[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        raw = [None if y is None or not of[k] else k - (k + 1) * y * of[k + 1] / of[k] for k in (1, 2, 3)]
        d = [max(0.1, min(k, k / 2 if r is None else r)) for k, r in zip((1, 2, 3), raw, strict=True)]
        steps.append(lambda c, d=d: d[min(c, 3) - 1])
        sums = {}
        for g, c in count[n].items():
            s = sums.setdefault(g[:-1], [0, 0.0])
            s[0] += c
            s[1] += min(steps[n](c), c)
        heads.append(sums)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(count[1]) + 1) if count[1] else kneser_ney.UNSEEN
        if g[:-1] not in heads[n]:
            return lower
        s, back = heads[n][g[:-1]]
        c = count[n].get(g, 0)
        return (max(c - steps[n](c), 0) / s if c else 0) + back / s * lower

    return p


def check_kneser_ney(spark, got, texts, langs, trusted):
    """got: rows by id; every perplexity and threshold against the plain model."""
    held = {r[0] for r in spark.createDataFrame([(i,) for i in trusted], "i long").where(F.pmod(F.xxhash64("i"), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    for lang in set(langs.values()):
        mine = [i for i in texts if langs[i] == lang]
        p = plain_kneser_ney([texts[i] for i in mine if i in trusted and i not in held])
        want = {}
        for i in mine:
            u = plain_units(texts[i])
            each = [math.log(p(tuple(u[k : k + 4]))) for k in range(len(u) - 3)]
            want[i] = math.exp(-sum(each) / len(each))
            assert got[i]["perplexity"] == pytest.approx(want[i], rel=1e-5) and got[i]["n_chars"] == len(texts[i] or "")
        scores = sorted(want[i] for i in mine if i in trusted and i in held)
        limit = scores[math.ceil(kneser_ney.QUANTILE * len(scores)) - 1] if scores else None
        assert all(got[i]["threshold"] == pytest.approx(limit, rel=1e-5) if scores else got[i]["threshold"] is None for i in mine)
        assert all(got[i]["kept"] == (not scores or got[i]["perplexity"] <= got[i]["threshold"]) for i in mine)


def test_rows_without_an_id_are_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 2000)
    texts = [prose(30, 6000 + k) for k in range(60)]
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id")))
    rows = kneser_ney.classify(docs, labels(spark, range(20), [1] * 20)).collect()
    assert len(rows) == 60 and sum(r["doc_id"] is None for r in rows) == 40
    whole = kneser_ney.classify(frame(spark, texts), labels(spark, range(20), [1] * 20)).collect()
    assert sorted(round(r["perplexity"], 6) for r in rows) == sorted(round(r["perplexity"], 6) for r in whole)


def test_every_perplexity(spark):
    """Characters beyond 16 bits, and those that share a number with the marks, are told apart."""
    texts = [t for t in TEXTS if len(t or "") < 4000] + ["a\ufffe\uffffb", "\ufffe\ufffe\ufffe", "\x02\x03", "😀😁😂", "😀", "\ufffd", "𐀀"]
    docs = frame(spark, texts)
    langs = {i: ["en", "fr", ""][i % 3] for i in range(len(texts))}
    trusted = [i for i in range(len(texts)) if i % 3 == 0 or i % 3 == 2 and i > 20]
    rows = kneser_ney.classify(docs, labels(spark, trusted, [1] * len(trusted))).collect()
    got = {r["doc_id"]: r for r in rows}
    check_kneser_ney(spark, got, dict(enumerate(texts)), langs, set(trusted))
    perplexity = {texts[i]: r["perplexity"] for i, r in got.items()}
    assert len(perplexity) == len({t: 0 for t in texts}) and got[len(texts) - 3]["n_chars"] == 1


# 8


def test_permutation(spark):
    for n in (1, 2, 17, 1000, 16777213):
        k = min(n, 1000)
        got = mixing.permute(spark.range(k).selectExpr("id AS k", f"{n}L AS n", "3L AS rank"), "b", "k", "n", "rank").toPandas().b
        assert got.nunique() == k and got.between(0, n - 1).all()


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        full |= over


def test_mixing(spark):
    texts = TEXTS + [prose(200, s) for s in range(300, 340)]
    df = frame(spark, texts).withColumn("source", F.expr("CASE WHEN doc_id = 20 THEN 'tiny' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'Z' ELSE source END"))
    got = mixing.taken(df, block=16).toPandas().set_index("doc_id")
    rows = df.toPandas().set_index("doc_id")
    want = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert got["size"].to_dict() == want
    source = {i: (None if s != s else s) for i, s in rows.source.items()}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += want[i]
    goal = plain_targets(sizes)
    for i, r in got.iterrows():
        assert r.source_size == sizes[source[i]] and abs(r.target - goal[source[i]]) < 1e-6 and r.taken <= 3 * r["size"]
    for s, g in goal.items():
        taken = sum(got.taken[i] for i in source if source[i] == s)
        assert abs(taken - g) <= max(48, 0.03 * g)
    assert mixing.taken(df.repartition(5), block=16).toPandas().set_index("doc_id").taken.to_dict() == got.taken.to_dict()
    out = mixing.mixed(df, block=16).toPandas()
    words = out.text.map(lambda t: len(WORD.findall(t))).groupby(out.doc_id).sum()
    assert words.to_dict() == {i: n for i, n in got.taken.items() if n}
    assert mixing.taken(odd(spark)).count() == len(TEXTS) + 2
    assert mixing.taken(empty(spark)).count() == 0


def plain_place(x, n, key, rounds):
    """The permutation of 0 .. n - 1, in Python's own numbers."""
    spread = lambda v: (v % 2147483647 * 48271 + 11) % 2147483647
    x = (x * 16777213 + key) % n
    for i in range(rounds):
        other = ((spread(key * 31 + i) * 131071 + spread(key * 37 + i + 5)) % n - x) % n
        mark = spread(max(x, other) + key * 7919 + i * 104729)
        if (mark * mark + mark) % 2147483647 % 2:
            x = other
    return x


def test_shards_are_draws_of_fixed_size(spark):
    """Counts of a shard sum to its slots, those of a source to its own; they vary as draws without replacement do."""
    rows = [(1, 700, 1500), (2, 60_000, 60_000), (3, 5, 15), (4, 9000, 30_000)]
    goal = spark.createDataFrame(rows, "rank long, blocks long, slots long")
    drawn = common.written(mixing.draw(goal, 256), "drawn")
    got = {(r["shard"], r["rank"]): r["n"] for r in drawn.collect()}
    total = sum(n for *_, n in rows)
    want, lead = Counter(), 0
    for rank, _, n in rows:
        want += Counter((plain_place(u, total, 7, mixing.DRAW_ROUNDS) // 256, rank) for u in range(lead, lead + n))
        lead += n
    assert got == dict(want)
    shards = -(-total // 256)
    assert [sum(got.get((s, r), 0) for r in (1, 2, 3, 4)) for s in range(shards)] == [256] * (shards - 1) + [total - 256 * (shards - 1)]
    for rank, _, n in rows:
        counts = np.array([got.get((s, rank), 0) for s in range(shards - 1)])
        share = n / total
        assert abs(counts.mean() - 256 * share) < 0.5 and 0.6 < counts.var() / (256 * share * (1 - share)) < 1.6
    each = mixing.slots(drawn).toPandas()
    assert each.groupby("shard").size().tolist() == [256] * (shards - 1) + [total - 256 * (shards - 1)]
    for rank, blocks, n in rows:
        of = each[each["rank"] == rank]
        assert len(of) == n and not of.duplicated(["block", "round"]).any() and set(of["round"]) == set(range(-(-n // blocks))) and of.block.between(0, blocks - 1).all()
        assert set(of[of["round"] == 0].block) == {plain_place(k, blocks, rank, mixing.ROUNDS) for k in range(min(n, blocks))}


def test_shards_hold_what_was_drawn(spark):
    """Each shard of the mix has as many blocks of each source as the draw gave it; other shards are another arrangement of the same words."""
    texts = [prose(RANDOM.randint(0, 300), 3000 + k) for k in range(120)]
    df = frame(spark, texts).drop("size")
    placed = common.written(mixing.place(df, block=16), "placed")
    goal = placed.where("size > 0").groupBy("rank").agg(F.max("blocks").alias("blocks"), F.max("slots").alias("slots"))
    drawn = {(r["shard"], r["rank"]): r["n"] for r in mixing.draw(goal, 50).collect()}
    assert len({s for s, _ in drawn}) > 5
    blocks = mixing.mix(placed, block=16, shard_slots=50).select("shard", "rank", "block", "round").distinct()
    assert {(r["shard"], r["rank"]): r["count"] for r in blocks.groupBy("shard", "rank").count().collect()} == drawn
    few, many = (mixing.taken(df, block=16, shard_slots=k).toPandas().set_index("doc_id") for k in (50, 4096))
    assert few.taken.to_dict() == many.taken.to_dict() and few.n_shards.sum() > many.n_shards.sum() and set(many.first_shard) <= {0, -1}
    per_doc = {}
    for r in mixing.mix(placed, block=16, shard_slots=50).select("doc_id", "shard").collect():
        per_doc.setdefault(r["doc_id"], set()).add(r["shard"])
    assert {i: (r.n_shards, r.first_shard) for i, r in few.iterrows() if r.taken} == {i: (len(s), min(s)) for i, s in per_doc.items()}


def test_mix_is_arranged_by_shard(spark):
    texts = [prose(RANDOM.randint(1, 300), 4000 + k) for k in range(120)]
    df = frame(spark, texts)
    out = mixing.mixed(df, block=16, shard_slots=50, shard_col="shard").withColumn("part", F.spark_partition_id()).toPandas()
    assert out.shard.nunique() > 5 and all(g.shard.is_monotonic_increasing for _, g in out.groupby("part"))
    other = mixing.mixed(df, block=16, shard_slots=4096).toPandas()
    assert sorted(out.text) == sorted(other.text)


def test_clashing_names_stay_as_they_are(spark):
    """Columns named like those that keep_one and mixed need on their way come back unchanged."""
    names = ["_row", "_size", "_n", "_parts", "_words", "_shard", "_ROW_"]
    df = frame(spark).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names})
    for out in (simhash.keep_one(df), mixing.mixed(df, block=16)):
        rows = out.collect()
        assert out.columns == df.columns and rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(s, k, k % 5 + 1) for s in ("a", None) for k in range(0, 60, 2)]
    got = mixing.running(spark.createDataFrame(rows, "s string, k long, v long"), ["s"], "k", "v", "before").collect()
    assert sorted(((r["s"] or ""), r["k"], r["before"]) for r in got) == sorted((s or "", k, sum(v for s2, k2, v in rows if s2 == s and k2 < k)) for s, k, _ in rows)


# 9


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x // 10 + 2 * x % 10 for k, x in enumerate(map(int, d[::-1]))) % 10 == 0


def plain_spans(t):
    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def constant():
    return pii.Model(boosting.fit(np.zeros((0, len(pii.FEATURES))), np.zeros(0), pii.FEATURES), [None] * 4)


def test_personal_data(spark):
    parts = ["1", "2.", "25", "4111111111111111", "+1 (", ".", "-", " ", "@", "a", "b.c", ",", ") é", "😀", "5555-5555-5555-4444", "12.34.56.255", "x@y.zz", "300", "\n", "+"]
    texts = ["".join(RANDOM.choice(parts) for _ in range(RANDOM.randint(0, 25))) for _ in range(1500)] + TEXTS + ["a" * 50_000 + "@" + "b." * 2000 + "c", "1" * 50_000, "1 " * 5000, "1." * 5000, "007.0255.1.00256 007.0255.1.0"]
    got = pii.find(frame(spark, texts), constant()).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)], texts[r["doc_id"]]
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(line.encode()).hexdigest(), line)
    assert pii.find(odd(spark), constant()).count() == len(TEXTS) + 2
    assert pii.find(empty(spark), pii.train(empty(spark))).count() == 0


def test_redaction(spark):
    texts = [None, "", "mail a.b@c.org or +1 (555) 010-9999.", "no data", "é 10.0.0.1😀", "4111 1111 1111 1111"]
    got = pii.redact(frame(spark, texts), constant())
    assert got.columns == frame(spark, texts).columns
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == [None, "", "mail [EMAIL] or [PHONE].", "no data", "é [IP]😀", "[CARD]"]
    assert [r["n_chars"] for r in got.where("doc_id = 2").collect()] == [len("mail [EMAIL] or [PHONE].")]


def test_proposals_are_learned(spark):
    r = random.Random(3)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for k in range(400):
        p = [prose(8, k)]
        p.append(f"mail user{k}@host{k % 7}.example.com now" if k % 2 else f"call +1 (555) {number(3)}-{number(4)} now")
        p.append(f'token = "{number(12)}{r.choice("abcdef")}{number(13)}" and id_{number(10)}x' if k % 3 else prose(5, k + 999))
        texts.append(" ".join(p))
    texts += ["please write to jane.doe at mail dot example dot com today", prose(40, 77)]
    model = pii.train(frame(spark, texts))
    got = {x["doc_id"]: x["spans"] for x in pii.find(frame(spark, texts), model).where("doc_id >= 390").collect()}
    assert got[400].startswith("email:") and got[401] == ""
    assert all(set(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[i])) <= set(s.split(",")) for i, s in got.items() if s)


#: Sentences that training never made: what should be found beside the base patterns, and what should not.
SENTENCES = [
    ("tel 415 555 0134", "phone"), ("phone 0041 44 668 18 00", "phone"), ("Call me at (212) 555 7788 tonight", "phone"), ("my mobile: 555.201.3344", "phone"), ("fax 030 1234 5678", "phone"), ("please phone 44 20 7946 0958", "phone"),
    ("mail me: jane at example dot com", "email"), ("contact john.smith [at] mail [dot] org", "email"), ("E-mail bob7 at corp dot example dot net now", "email"), ("write to a_b (at) host (dot) io", "email"),
    ("Order 4111.1111.1111.1111 paid", "card"), ("visa 4111/1111/1111/1111 on file", "card"), ("card 5555_5555_5555_4444", "card"), ("credit card 3782.822463.10005", "card"),
    ("ip 10 . 0 . 0 . 12 is down", "ip"), ("server 192:168:1:20", "ip"), ("host 172 . 16 . 254 . 1", "ip"),
    ("In 1998 1999 2000 sales rose", None), ("On 2024-01-05 10 people came", None), ("order number 1234567890 was sent", None), ("invoice 2023/000417 is due", None), ("built 20240105.121530 by the robot", None), ("look at home dot something", None),
    ("at 12:30:45:10 it stopped", None), ("version 4.18.300.2 came out", None), ("id_8273645519x was lost", None), ("the number 4111.1111.1111.1112 is wrong", None), ("page 12, 14, 16, 18 of it", None), ("sum 1234 5678 9012 is large", None),
]


def announced(spark):
    """Documents with base spans as a corpus has them: no word announces any."""
    r = random.Random(8)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for k in range(1200):
        card = next(c for x in range(10) if luhn(c := f"4{k:03d}{k * 7919 % 10**11:011d}{x}"))
        span = [f"user{k}.x@mail{k % 9}.example.com", f"{k % 200 + 10}.{k % 250}.7.{k % 99}", card, f"+1 ({d(3)}) 555-{d(4)}"][k % 4]
        texts.append(f"{prose(30, k)} {span} {prose(20, k + 500)}")
    return frame(spark, texts)


def test_sentences_that_training_never_made(spark):
    model = pii.train(announced(spark))
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, [t for t, _ in SENTENCES]), model).collect()}
    kinds = {i: [x.split(":")[0] for x in got[i].split(",") if x] for i in got}
    caught = {k: [kinds[i] == [k] for i, (_, want) in enumerate(SENTENCES) if want == k] for k in pii.KINDS}
    wrong = [SENTENCES[i][0] for i, (_, want) in enumerate(SENTENCES) if want is None and kinds[i]]
    assert {k: sum(c) / len(c) for k, c in caught.items() if sum(c) < 0.6 * len(c)} == {} and wrong == []
    assert kinds[10] == ["card"] and all("ip" not in kinds[i] for i, (_, want) in enumerate(SENTENCES) if want == "card")


def test_thresholds(spark):
    """So many wrong ones may lie above a threshold, and it is never below even odds; without base spans nothing is added."""
    b = pii.BINS
    assert pii.threshold({}) == 0.0 and pii.threshold({-5 * b: 10, -b: 3}) == 0.0
    assert pii.threshold({2 * b: 1, b: 10, -b: 989}) == (b + 1) / b and pii.threshold({2 * b: 1}) == (2 * b + 1) / b
    docs = frame(spark, [f"{prose(8, k)} 555 010 {k:04d}" for k in range(30)])
    model = pii.train(docs)
    assert model.least == [None] * 4 and all(r["spans"] == "" for r in pii.find(docs, model).collect())
    few = pii.train(announced(spark), rows=40, look_alikes=20)
    assert all(x is not None and x >= 0 for x in few.least)


def test_numbers_beside_numbers_are_proposed(spark):
    texts = ["é 555 010 9999 555 010 8888", "5 2024 4111.1111.1111.1111", "no. 42 4111.1111.1111.1111", "call 10.0.0.1 now 1:2:3:4:5", "1 " * 5000, "nothing 12", None]
    got = {r["doc_id"]: r for r in pii._spans(frame(spark, texts), "doc_id", "text").collect()}

    def plain(text, base, kind):
        runs = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
        for i in range(len(runs)):
            for j in range(i, min(len(runs), i + 19)):
                if j > i and not re.match(pii.BETWEEN[kind].replace(r"\z", r"\Z"), text[runs[j - 1][1] : runs[j][0]]):
                    break
                a, b = runs[i][0], runs[j][1]
                n = sum(y - x for x, y in runs[i : j + 1])
                if pii.RUNS[kind][0] <= j - i + 1 <= pii.RUNS[kind][1] and pii.DIGITS[kind][0] <= n <= pii.DIGITS[kind][1] and all(b <= s["start"] or s["end"] <= a for s in base):
                    yield a, b, text[a:b], text[max(0, a - 24) : a], text[b : b + 1]

    for i, text in enumerate(texts):
        for kind in (1, 2, 3):
            assert [tuple(m) for m in got[i][f"wide{kind}"]] == list(plain(text or "", got[i]["base"], kind)), (text, kind)
    spans = lambda i, kind: {m["match"] for m in got[i][f"wide{kind}"]}
    assert {"555 010 9999", "555 010 8888"} <= spans(0, 3) and "4111.1111.1111.1111" in spans(1, 2) & spans(2, 2) and spans(3, 1) == {"1:2:3:4", "2:3:4:5"}


def test_best_of_overlaps_is_taken_first(spark):
    """A number that only a beaten one overlaps stays."""
    texts = ["555 010 9999 555 010 8888"]
    ten = boosting.Trees(np.array([0]), np.array([2, 2, 0, 0, 0]), np.array([10.0, 9.0, 0, 0, 0]), np.array([1, 3, 2, 3, 4]), np.array([2, 4, 2, 3, 4]), np.array([0, 0, -9.0, -9.0, 9.0]), 0.0, 2, pii.FEATURES)
    got = pii.find(frame(spark, texts), pii.Model(ten, [None, None, None, 0.0])).collect()
    assert got[0]["spans"] == "phone:0:12,phone:13:25"


# null and repeated ids in stages of the pipeline


def test_one_row_of_each_group_stays(spark):
    texts = [prose(80, 501), prose(80, 501), prose(80, 502), prose(80, 502), prose(80, 503), prose(80, 504), prose(80, 504)]
    got = simhash.keep_one(frame(spark, texts, [7, 7, None, 3, None, None, None]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(7, texts[0]), (3, texts[2]), (0, texts[4]), (0, texts[5])])
    assert got.columns == frame(spark, texts).columns


def test_mix_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"w{k}x{n}" for n in range(100)) for k in (0, 1, 0, 3, 4)]
    df = frame(spark, texts, [1, 1, 1, None, None])
    out = Counter()
    for r in mixing.mixed(df, block=16).collect():
        (text,) = (t for t in set(texts) if set(WORD.findall(r["text"])) <= set(WORD.findall(t)))
        out[r["doc_id"], text] += len(WORD.findall(r["text"]))
    # taken() has one row for each row of docs, so both count the same words.
    want = Counter()
    for r in mixing.taken(df, block=16).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for (i, text), n in out.items():
        got[i] += n
        assert n <= 3 * 100 * texts.count(text)
    assert got == want and want[None] > 0
    assert {i for i, _ in out} == {1, None}


# 10


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 1, 0.5) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, label int, score double")


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x[100:400] = x[50] + 0.05 * r.normal(size=(300, 32))
    x[500:540] = x[0]
    extra = [(3000, None, 1, 0.0), (3050, [0.0] * 32, 1, 0.0), (3100, [1.0] * 31 + [None], 1, 0.0), (3150, [float("nan")] * 32, 1, 0.0), (3200, [float("inf")] * 32, 1, 0.0), (None, [1.0] * 32, 1, 0.0), (4000, [1.0, 2.0], 1, 0.0), (4001, [2.0, 1.0], 1, 0.0)]
    old, ann.GROUP_BYTES = ann.GROUP_BYTES, 1 << 18
    try:
        got = ann.nearest(vectors(spark, x, extra), F.col("vec_id") % 50 == 0).toPandas()
    finally:
        ann.GROUP_BYTES = old
    assert set(got.query_id) == {*range(0, 3000, 50), 4000}
    assert got[got.query_id == 4000].vec_id.tolist() == [4001] and got[got.query_id == 4000].score.iloc[0] == pytest.approx(0.8)
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    hit = 0
    for q in range(0, 3000, 50):
        s = (d * d[q]).sum(axis=1) / (n * n[q])
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        g = got[got.query_id == q].sort_values("rank")
        hit += len(set(want) & set(g.vec_id))
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-15)
    assert hit / 300 >= 0.98
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [500, 501, 502, 503, 504]
    assert ann.nearest(vectors(spark, x[:0]), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(vectors(spark, x[:3]), F.col("vec_id") % 50 == 0).count() == 2


def test_tiny_and_huge_vectors_take_part(spark):
    """Figures that underflow or overflow when squared; no query loses its rows, and scores are true cosines."""
    r = np.random.default_rng(9)
    plain = r.normal(size=(200, 8))
    x = plain * np.where(np.arange(200) % 4 == 0, 1e-200, np.where(np.arange(200) % 4 == 1, 1e200, np.where(np.arange(200) % 4 == 2, 1e-310, 1.0)))[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    n = np.sqrt((plain * plain).sum(axis=1))
    for q in range(0, 200, 50):
        s = plain @ plain[q] / (n * n[q])
        g = got[got.query_id == q].sort_values("rank")
        assert g.vec_id.tolist() == [i for i in np.argsort(-s) if i != q][:5]
        assert np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-9)  # 1e-310 has fewer digits


def test_lists_are_visited_as_far_as_needed(spark, monkeypatch):
    """Clusters: many lists, few of them visited, chunks and parts of lists, and the true neighbours are found."""
    for name, value in {"LIST_ROWS": 64, "CHUNK": 3, "GROUP_BYTES": 1 << 14, "SAMPLE": 2000}.items():
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(11)
    middle = r.normal(size=(60, 24))
    x = (middle[r.integers(0, 60, 4000)] + 0.3 * r.normal(size=(4000, 24))).astype(np.float32)
    x[1000:2300] = x[7]  # a third of all rows are copies
    df = vectors(spark, x)
    layout = ann.Layout.fit(ann.clean(df, "vec_id", "embedding"), 5)
    assert len(layout.middle[24]) > 20 and layout.visit[24] < len(layout.middle[24]) / 2
    assert ann.candidates(ann.clean(df, "vec_id", "embedding"), 5).count() == 4000 - 1301 + 6
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (d * d[q]).sum(axis=1) / (n * n[q])
        hit += len({i for i in np.lexsort((np.arange(4000), -s))[:6].tolist() if i != q} & set(g.vec_id))
    assert got.query_id.nunique() == 80 and hit >= 0.95 * 400
    assert got[got.query_id == 1050].sort_values("rank").vec_id.tolist() == [7, 1000, 1001, 1002, 1003]


def test_packed_estimates(spark):
    """Estimates from packed bits lie within their bounds for nearly all pairs; repeated ids come once."""
    r = np.random.default_rng(3)
    x, q = r.normal(size=(500, 128)), r.normal(size=(40, 128))
    index = ann.build_index(ann.clean(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding"), ann.Layout({}, {})).toPandas().sort_values("id")
    g = ann.Group(index.id.to_numpy(), x, np.stack([np.frombuffer(c, np.uint8) for c in index.code]), index.rest.to_numpy(), index.fit.to_numpy(), np.zeros(128))
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    true = unit(q) @ unit(x).T
    a, ids, score = g.search(np.full(40, -1), q, 5, np.full(40, -np.inf))
    assert np.allclose(score, true[a, ids]) and sum(len(set(ids[a == i]) & set(np.argsort(-true[i])[:5])) for i in range(40)) >= 195
    assert [c.tolist() for c in ann.top(np.array([0, 0, 0]), np.array([4, 4, 2]), np.array([0.1, 0.5, 0.2]), 2)] == [[0, 0], [4, 2], [0.5, 0.2]]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_shared_folder_is_that_of_the_session(spark):
    class Session:
        def __init__(self, place):
            self.conf, self.sparkContext = self, spark.sparkContext
            self.place = place

        def get(self, key, default=None):
            return self.place if key == "spark.checkpoint.dir" else spark.conf.get(key, default)

    assert common.shared_folder(spark)
    assert common.fresh_folder(Session("hdfs:///some/place/"), "x").startswith("hdfs:///some/place/x-")


def test_hot_keys_meet_their_groups(spark):
    """Keys above the bound and below it, keys without a group, null keys: the same rows as a plain join."""
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 7 + [3, 4, 4, None])], "k long, i long")
    groups = spark.createDataFrame([(1, 50, "a"), (2, 7, "b"), (4, 2, "c"), (9, 1, "d")], "k long, n long, name string")
    for least in (1, 5, 1000):
        got = common.meet(rows, groups, ["k"], least=least).select("k", "i", "name").collect()
        assert sorted(got) == sorted(rows.join(groups, "k").select("k", "i", "name").collect()) and len(got) == 59
    assert common.meet(rows.where("k > 99"), groups.where("k > 99"), ["k"]).count() == 0


def test_common_windows_are_dealt_to_many_tasks(spark, monkeypatch):
    """With every hash that repeats in the sample taken as common, nothing changes."""
    passage = prose(40, 700)
    texts = [prose(20, 701 + k) + " " + passage + " " + prose(15, 800 + k) for k in range(12)] + [passage, None, prose(50, 900)]
    for name, value in {"SAMPLED": 1, "COMMON": 2, "SALTS": 3}.items():
        monkeypatch.setattr(substring, name, value)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(frame(spark, texts)).collect()}
    assert got == plain_dedup(dict(enumerate(texts)), 13)


def test_spans_beside_very_many_base_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "STRIDE", 4)
    text = " ".join(f"10.0.0.{i} user{i} at host dot example dot org" for i in range(40))
    r = pii._spans(frame(spark, [text, "no data"]), "doc_id", "text").orderBy("doc_id").collect()
    assert len(r[0]["base"]) == 40 and len(r[0]["wide0"]) == 40 and r[1]["wide0"] == []
    assert all(b["end"] <= m["start"] or m["end"] <= b["start"] for k in range(4) for m in r[0][f"wide{k}"] for b in r[0]["base"])


def test_written_tables_can_be_removed(spark):
    common._made.clear()
    df = common.written(spark.range(3).toDF("id"), "three")
    since = common.mark()
    common.written(spark.range(2).toDF("id"), "two")
    assert common.remove_written(spark, since) == 1 and df.count() == 3
    assert common.remove_written(spark) == 1 and common.remove_written(spark) == 0
