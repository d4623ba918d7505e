"""Every operator on rows made to break it (nulls, empty and long texts, ties, repeats, clashing columns, no rows), against brute force."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.llm import byte_bpe, chat_format, components, decontaminate, html_extract, jaccard_join, line_dedup, lm_score, quality, substring_dedup, token_table
from rankweave.llm.common import NULL_ID, fresh_dir, join_hot

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, k long, h long"


def made(seed=3, n=60):
    """Documents with copies, near copies, shared lines and passages, odd bytes, nulls and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgéñ") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(25)) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(r.randint(3, 40))) for _ in range(r.randint(1, 5))]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        text = "\n".join(lines)
        if out and r.random() < 0.3:
            text = r.choice([x for x in out if x[1]])[1]
            if r.random() < 0.6:
                words = text.split(" ")
                words[r.randrange(len(words))] = "CHANGED"
                text = " ".join(words)
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (None, "a null id with some words in it"), (n + 3, "x" * 3000), (n + 4, "Ω\x1c\x85 ’  two  spaces\r\n\x00 end"), out[5], (7, "another text under the id of seven")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 1, 2) for i, t in made()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def files(spark, docs):
    path = fresh_dir(spark, "docs")
    docs.write.parquet(path)
    return spark.read.parquet(path)


def none(docs):
    return docs.filter("doc_id = -99")


def key(i):
    return NULL_ID if i is None else i


# 1

def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    text = "one two three four five six seven eight nine\n" * 2 + "| $ * ##\n\none"
    extra = spark.createDataFrame([(900, text, "en", "", "", 0, 0)], SCHEMA)
    rows = {(r["doc_id"]): r for r in quality.quality(docs.unionByName(extra), labels).collect()}
    r = rows[900]
    assert (r["n_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (23, 5, 1, 18, True, False)
    assert rows[60]["n_words"] == rows[61]["n_words"] == rows[62]["n_words"] == 0 and rows[60]["base_failed"] and not rows[60]["kept"]
    assert quality.quality(docs, labels).count() == docs.count() and quality.quality(none(docs), labels).count() == 0
    assert all(r["score"] == 0 for r in quality.quality(docs, labels.limit(0)).collect())


def test_quality_tells_planted_words(spark):
    r = random.Random(1)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words = [r.choice(common) for _ in range(80)]
        bad = i % 10 == 0
        if bad:
            words[10:14] = ["vile", "rot", "vile", "rot"]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = [r for r in out if r["doc_id"] % 10 == 0]
    assert not any(r["kept"] for r in bad) and sum(r["kept"] for r in out) >= 0.98 * (len(out) - len(bad))


def test_quality_gives_rare_words_a_weight_in_small_tables(spark):
    r = random.Random(8)
    common, insults = [f"w{i}" for i in range(300)], [f"vile{i}" for i in range(10)]
    rows, labels = [], []
    for i in range(300):  # each insult is in about 15 documents, of which five would be trusted by chance
        words = [r.choice(common) for _ in range(80)]
        if bad := i % 10 == 0:
            for p in range(0, 80, 8):
                words[p] = r.choice(insults)
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words = spark.createDataFrame([(w,) for w in insults], "w string").select(quality._word_buckets(F.col("w"))[0].alias("bucket"))
    weights = words.join(quality.bucket_weights(docs, labels, "doc_id", "text"), "bucket").collect()
    assert len(weights) == 10 and all(r["weight"] < 0 for r in weights)
    out = quality.quality(docs, labels).collect()
    bad = [r for r in out if r["doc_id"] % 10 == 0]
    assert not any(r["kept"] for r in bad) and sum(r["kept"] for r in out) >= 0.98 * (len(out) - len(bad))


def test_quality_against_brute_force(spark, docs):
    """Counts, weights, score and verdict of every document, from features told apart in Python; only their hashes are Spark's."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in ids if i % 4]
    trusted = {i for i, q, t in labels if q and not t}
    space, punctuation = " \t\n\x0b\x0c\r", "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

    def words(text):
        out = (text or "").lower().translate({ord(c): " " for c in space}).split(" ")
        return [w for w in out if w]

    def singles(w):
        stem = w.rstrip(punctuation)
        return [(kind, x) for kind, x in ((1, stem), (2, w[len(stem):])) if x]

    every = {f for _, t in rows for w in words(t) for f in singles(w)}
    pairs = {p for _, t in rows for p in zip(words(t), words(t)[1:])}
    hashed = spark.createDataFrame([(k, x) for k, x in every], "k int, x string").select("k", "x", F.xxhash64("k", "x").bitwiseAND(quality.HALF - 1).alias("b")).collect()
    bucket = {(r["k"], r["x"]): r["b"] for r in hashed}
    hashed = spark.createDataFrame([*pairs], "a string, c string").select("a", "c", quality._pair_bucket(F.col("a"), F.col("c")).alias("b")).collect()
    bucket |= {(r["a"], r["c"]): r["b"] for r in hashed}

    raw, good = Counter(), Counter()
    for i, t in rows:
        found = [bucket[f] for w in set(words(t)) for f in singles(w)] + [bucket[p] for p in zip(words(t), words(t)[1:])]
        raw.update(found)
        good.update(found if i in trusted else ())
    weight = {}
    for b in raw:
        half = [x for x in raw if (x >= quality.HALF) == (b >= quality.HALF)]
        e = raw[b] * sum(good[x] for x in half) / sum(raw[x] for x in half)
        if e > 0:
            told = max(2 * ((good[b] * math.log(good[b] / e) if good[b] else 0) - good[b] + e), 0)
            doubt = quality.PAIR_EVIDENCE if b >= quality.HALF else quality.EVIDENCE
            weight[b] = math.log((good[b] + quality.SMOOTHING) / (e + quality.SMOOTHING)) * (told / (told + doubt)) ** quality.POWER * quality.UNIT
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["bucket"]: r["weight"] for r in quality.bucket_weights(docs, labels, "doc_id", "text").collect()}
    assert set(got) == set(weight) and all(abs(got[b] - weight[b]) < 0.51 for b in got)

    out = Counter((r["doc_id"], r["n_words"], round(r["score"], 9), r["kept"]) for r in quality.quality(docs, labels).collect())
    want = Counter()
    for i, t in rows:
        ws = words(t)
        total = sum(got.get(bucket[f], 0) for w in ws for f in singles(w)) + sum(got.get(bucket[p], 0) for p in zip(ws, ws[1:]))
        windows = Counter(tuple(ws_[k: k + 8]) for ws_ in [(t or "").translate({ord(c): " " for c in space}).split()] for k in range(len(ws_) - 7))
        cased = [w for w in (t or "").translate({ord(c): " " for c in space}).split(" ") if w]
        again = {k + j for k in range(len(cased) - 7) if windows[tuple(cased[k: k + 8])] > 1 for j in range(8)}
        failed = len(ws) < 20 or 100 * len(again) > 30 * len(ws)
        score = total / (len(ws) + quality.PRIOR_WORDS)
        want[i, len(ws), round(score / quality.UNIT, 9), not failed and score >= quality.THRESHOLD * quality.UNIT] += 1
    assert out == want


def test_quality_counts_all_features_in_one_reading(spark, files):
    rows = files.select(F.lit(1).alias("__good"), F.coalesce("text", F.lit("")).alias("__text"))
    assert quality._counts(rows)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    odd = [" a\tb \n c", "a\n\nb  c ", "\x0b\x0c\r", "", " ", "a\u00a0b\x85c d\x1ce"]
    words = spark.createDataFrame([(x,) for x in odd], "t string").select(quality.word_list(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in words] == [["a", "b", "c"], ["a", "b", "c"], [], [], [], ["a\u00a0b\x85c", "d\x1ce"]]


# 2

def test_substring_dedup(docs):
    rows = sorted(((key(i), t or "") for i, t in made()), key=lambda x: x[0])
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    want = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) > 0))
        want[i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    got = Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == want and sum(n[2] > 0 for n in want) > 5
    assert substring_dedup.remove_repeats(none(docs)).count() == 0


def test_substring_dedup_deletes_what_it_has_read(docs, monkeypatch):
    alive = {}

    def materialize(df, tag, f=substring_dedup.materialize):
        out = f(df, tag)
        alive[out.rankweave_path] = tag
        return out

    def discard(*tables, f=substring_dedup.discard):
        f(*tables)
        for x in tables:
            del alive[x.rankweave_path]

    monkeypatch.setattr(substring_dedup, "materialize", materialize)
    monkeypatch.setattr(substring_dedup, "discard", discard)
    out = substring_dedup.remove_repeats(docs)
    assert sorted(alive.values()) == ["hits", "placed"] and out.count() == docs.count()  # what the result itself reads


def test_substring_names_go_in_packs(docs, monkeypatch):
    """Names are told apart in packs, not as a row each, with the same result however small the packs are."""
    rows = lambda df: Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())
    want = rows(substring_dedup.remove_repeats(docs))
    monkeypatch.setattr(substring_dedup, "GATHER", 100)
    monkeypatch.setattr(substring_dedup, "PER_BUCKET", 50)
    assert rows(substring_dedup.remove_repeats(docs)) == want
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc ") for _ in range(400)) for _ in range(30)]
    texts += [x[100:300] + y[50:250] for x, y in zip(texts[:10], texts[10:20])]
    parts = [i % 3 for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.binary())], names=["k", "part", "text"])
    packs = list(substring_dedup._gather_names(8)(iter([batch])))
    assert sum(b.num_rows for b in packs) == 3 * 8
    by_bucket = pa.Table.from_batches(packs).sort_by("bucket").to_batches()
    got = defaultdict(set)
    for b in substring_dedup._names_in_several(iter(by_bucket)):
        for part, x in zip(b.column("part").to_pylist(), b.column("names").to_pylist()):
            got[part].update(np.frombuffer(x, np.uint64).tolist())
    having = defaultdict(set)
    for k, text in enumerate(texts):
        for b in substring_dedup.Buffer.of([text]):
            for name in b.anchors()[2].tolist():
                having[name].add(k)
    for part in range(3):  # texts in one run of bytes may have more anchors than by themselves
        assert {n for n, ks in having.items() if len(ks) > 1 and part in {parts[k] for k in ks}} <= got[part]


def test_substring_names_differ_by_the_last_byte_of_eight():
    base = bytearray(b"the same sixteen")
    seen = set()
    for a in range(256):
        for b in range(256):
            base[7], base[15] = a, b
            seen.add(int(substring_dedup.names(np.frombuffer(bytes(base), np.uint8), 16)[16][0]))
    assert len(seen) == 1 << 16


def test_long_texts_are_cut_into_segments(monkeypatch):
    r = random.Random(2)
    text = bytes(r.choice(b"abc ") for _ in range(5000))
    whole = [x for b in substring_dedup.Buffer.of([text]) for x in zip(*b.anchors(), strict=True)]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    assert sorted(whole) == sorted(x for b in substring_dedup.Buffer.of([text]) for x in zip(*b.anchors(), strict=True))


# 3

def test_line_dedup(docs):
    rows = [(key(i), t or "") for i, t in made()]
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(fold(x)) >= 10:
                holders[fold(x)].add(i)
    want = Counter()
    for i, t in rows:
        lines = t.split("\n")
        stay = [x for x in lines if len(holders.get(fold(x), ())) < 2 or min(holders[fold(x)]) == i]
        want[i, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    for batches in (1, 4):
        out = line_dedup.dedup_lines(docs, batches=batches)
        assert Counter((key(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert out.columns[:2] == ["doc_id", "text"] and "k" in out.columns
    assert line_dedup.dedup_lines(none(docs)).count() == 0


# 4

def test_contamination(spark, docs):
    texts = made()
    items = [(1, " ".join(texts[3][1].split()[:15])), (2, texts[8][1].split()[0] + "!" + texts[8][1].split()[1]), (3, "???"), (4, None), (1, " ".join(texts[3][1].split()[:15]))]
    words = {i: decontaminate.words(t) for i, t in items}
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=16, clean=True)
    want = Counter()
    for i, t in texts:
        w, hit, found = decontaminate.words(t), set(), set()
        for item, x in words.items():
            n = min(13, len(x))
            for g in {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p:p + n]) == g:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want[i, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["hit_items"]), r["contaminated"]) for r in rows) == want
    assert all(len(decontaminate.words(r["clean_text"])) == r["n_words"] - r["n_hit"] for r in rows) and any(r["n_hit"] for r in rows)
    assert decontaminate.contamination(none(docs), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


# 5

def test_byte_bpe(files):
    import tiktoken

    path = P.path(byte_bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    out = byte_bpe.encode_bytes(files, path, P.PATTERN)
    for r in out.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode_bytes(none(files), path, P.PATTERN).count() == 0


# 6

def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "[\\INST] <s> \\ [[INST]"), (1, 1, "assistant", "<\\\\/s>"), (1, None, "odd\nrole%", None), (None, 0, None, "x"), (2, 0, "assistant", "a" * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rendered = chat_format.format_turns(df)
    whole = "".join(r["rendered"] for r in rendered.collect())
    assert sorted((a, b) for a, b, _ in chat_format.parse(whole)) == sorted((r or "", t or "") for _, _, r, t in turns)
    got = {r["conv_id"]: r for r in chat_format.read_back(rendered).collect()}
    texts = ["<\\\\/s>", "[\\INST] <s> \\ [[INST]"]
    ordered = sorted(texts, key=lambda t: chat_format.render_turn("assistant", t))
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256("".join(ordered).encode()).hexdigest() and got[2]["loss_chars"] == 100_000
    assert set(got) == {None, 1, 2} and chat_format.read_back(rendered.limit(0)).count() == 0
    for bad in ("x", "[INST]user", "[INST]user\nno end", "<s>assistant\n[INST]</s>"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


# 7

def test_html(spark):
    page = ("<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>home</a></nav><article><h1>Head &amp; tail</h1><p><b>First  paragraph\nhere.<br><p>Be.</p>"
            "<div class='ad'>Buy this fine thing now, it is cheap.</div><script>var t='</p>'</script></article><section id=comments><p>A long and thoughtful reader comment.</p></section>"
            "<aside><p>Related stories that are long enough.</p></aside><form><p>Your name here, please.</p></form><footer>&copy; x</footer>")
    rows = [(1, "u", page, "clash"), (2, None, None, ""), (3, "u", "", ""), (4, "u", "<p>" + "word " * 5000 + "end.", ""), (None, "u", "<<<>&am", "")]
    got = {r["page_id"]: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Head & tail\nFirst paragraph here.\nBe." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["n_chars"] == 25004


def test_minimum_cut_is_the_cheapest_labelling():
    r = random.Random(5)
    for _ in range(30):
        n = r.randint(1, 7)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda y: sum(html_extract._loss(s if not k else -s) for s, k in zip(scores, y, strict=True)) + sum(round(1000 * w) for (i, j), w in edges.items() if y[i] != y[j])  # noqa: E731, B023
        best = min(cost([b >> i & 1 for i in range(n)]) for b in range(1 << n))
        assert cost(html_extract.label(scores, edges)) == best


# 8

def test_lattice_sums_all_paths():
    v = lm_score.Vocabulary(P.path(lm_score.VOCABULARY))
    p = np.append(v.prior, 0.01)
    for w in ("the", "xé", "漢字a"):
        s = lm_score.SPACE_MARK + w

        def paths(i, s=s):
            if i == len(s):
                return 1.0
            total = 0.0
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in v.ids:
                    total += p[v.ids[s[i:j]]] * paths(j)
                elif j == i + 1:
                    total += math.prod(p[v.bytes[b]] for b in s[i].encode()) * paths(j)
            return total

        lattice = lm_score.Lattice(v, [b"zz", w.encode(), b"q"])
        assert math.exp(lattice.forward(np.log(p + 1e-300))[0][1]) == pytest.approx(paths(0), rel=1e-9)
        mass = lattice.expected(np.log(p + 1e-300), np.array([0, 1, 0]))
        assert mass.sum() >= 1 - 1e-9


def test_scores(files):
    rows = files.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if not lm_score.held_out(r["doc_id"]):
            counts.update([*lm_score.words(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_score.score_texts(files, P.path(lm_score.VOCABULARY))
    want = Counter((r["doc_id"], len(w := [*lm_score.words(r["text"]), None]), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for r in rows)
    out = got.collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out) and lm_score.score_texts(none(files), P.path(lm_score.VOCABULARY)).count() == 0


# 9

def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    return out


def brute(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("group", [3, 2000])
def test_jaccard_components(spark, group):
    r = random.Random(11)
    rows = []
    for c in range(5):
        base = [f"w{c}_{i}" for i in range(r.randint(3, 120))]
        for _ in range(12):
            text = [w if r.random() > 0.02 else f"x{r.random()}" for w in base[: len(base) - r.randint(0, len(base) // 8)]]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, rows[0][1]), (len(rows) + 3, "one two"), (len(rows) + 4, "ONE two")]
    sets = sets_of(rows)
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group_sets=group).collect()
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in out} == {i: (len(sets[i]), c) for i, c in brute(sets).items()}


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_short_sets_share_a_signature(percent):
    r = np.random.default_rng(5)
    for _ in range(150):
        pool = r.integers(0, 1 << 64, 18, np.uint64, endpoint=False)
        for n in range(1, 15):
            for m in range(n, 16):
                for common in range(jaccard_join.need(n, m, percent), n + 1):
                    if n + m - common > len(pool) or n == m == common:
                        continue
                    x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:n + m - common]]))
                    assert np.intersect1d(jaccard_join.signatures(x, percent), jaccard_join.signatures(y, percent)).size, (x, y)


def test_jaccard_links_short_texts_whose_equal_part_is_empty(spark):
    r, shingler, rows = random.Random(6), jaccard_join.Shingler(), []
    while len(rows) < 8:  # six shingles in one part of three, the seventh in it too
        text = " ".join(f"v{r.randrange(10 ** 6)}" for _ in range(10))
        part = (shingler(text) >> np.uint64(11)) * np.uint64(3) >> np.uint64(53)
        if (part == part[0]).all():
            rows += [(len(rows), text), (len(rows) + 1, text.rpartition(" ")[0])]
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"]: r["component"] for r in out} == {i: i - i % 2 for i in range(8)}


def test_jaccard_odd_rows(docs):
    out = jaccard_join.jaccard_classes(docs)
    assert out.count() == docs.count() and jaccard_join.jaccard_classes(none(docs)).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {60, 61, 62} <= {r["doc_id"] for r in kept.collect()}


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(x) for x in components.components(df).collect()}
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {tuple(x) for x in components.components(df).collect()} == one and (440, 400) in one


# 10

def test_token_table(spark, docs):
    from tokenizers import Tokenizer

    path = P.path(token_table.VOCABULARY)
    library = Tokenizer.from_file(path)
    manifest = token_table.write_shards(docs, fresh_dir(spark, "tokens"), path, shard_bytes=4000)
    out = sorted(token_table.read_shards(manifest).collect(), key=lambda r: r["start"])
    want = sorted(((key(i), t or "") for i, t in made()))
    at = 0
    for r, (i, t) in zip(out, want, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (key(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert manifest.count() > 1 and len(token_table.lookup(manifest, 7)) == 2 and token_table.lookup(manifest, 5000) == []
    assert token_table.read_shards(token_table.write_shards(none(docs), fresh_dir(spark, "tokens"), path)).count() == 0


# shared

def test_join_hot_equals_a_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 2 else 1, i) for i in range(3000)], "h long, i long")
    right = left.groupBy("h").agg(F.count("*").alias("n"), F.min("i").alias("f"))
    got = join_hot(left, right, ["h"], "n", 3000, parts=10)
    assert sorted(map(tuple, got.select("h", "i", "n", "f").collect())) == sorted(map(tuple, left.join(right, "h").select("h", "i", "n", "f").collect()))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t in made(seed=9, n=40) if i is not None and t]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[2][1].split()[:14]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, good, str(tmp_path)).collect()}
    roots = brute(sets_of(lines.items()))
    alone = {i for i in lines if roots[i] == i}
    item = decontaminate.words(" ".join(rows[2][1].split()[:14]))
    clean = {}
    for i in alone:
        w, hit = decontaminate.words(lines[i]), set()
        for a in (0, 1):
            for p in range(len(w) - 12):
                if w[p:p + 13] == item[a:a + 13]:
                    hit.update(range(p, p + 13))
        if not hit or 20 * len(hit) < len(w):
            clean[i] = hashlib.sha256(lines[i].encode()).hexdigest()
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == clean and json.dumps(sorted(got))


def test_html_cut_decides(spark):
    """Short lines go into an article and prose out of a box of comments, against their own scores; the cut is the cheapest of all labellings."""
    page = ('<html><head><title>x</title><body><article><h1>A</h1><p>Hi</p><div class="comments"><p>This is a long and well written comment, with many words, '
            'that nobody wants to have.</p><p>And this is another one, somewhat shorter.</p></div></article><nav><a href="x">Home</a></nav></body></html>')
    blocks, containers = html_extract.parsed(page)
    scores, edges = html_extract.graph(blocks, containers)
    keep = html_extract.label(scores, edges)
    assert [b[0] for b, k in zip(blocks, keep) if k] == ["A", "Hi"]
    assert sum((s > 0) != k for s, k in zip(scores[: len(blocks)], keep)) == 2

    def cost(labels):
        loss = sum(html_extract._loss(-s if k else s) for s, k in zip(scores, labels))
        return loss + sum(round(html_extract.UNIT * w) for (u, v), w in edges.items() if labels[u] != labels[v])

    least = min(cost([bool(m >> i & 1) for i in range(len(scores))]) for m in range(1 << len(scores)))
    assert cost(keep) == least


def test_html_rows(spark):
    """No rows, repeated rows, null and empty pages, pages without an end of the head, clashing columns."""
    schema = "page_id long, html string, text string, n_chars string"
    assert html_extract.extract_text(spark.createDataFrame([], schema)).collect() == []
    data = [(1, "<p>Short note</p>"), (1, "<p>Short note</p>"), (2, None), (3, ""), (4, "<head><title>t</title><body><p>No end of the head.</p>"), (5, "plain &amp; simple words, in one line.")]
    out = html_extract.extract_text(spark.createDataFrame([(i, h, "a", "b") for i, h in data], schema)).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [
        (1, "Short note", 10), (1, "Short note", 10), (2, "", 0), (3, "", 0), (4, "No end of the head.", 19), (5, "plain & simple words, in one line.", 34)]


def test_jaccard_signatures_lose_no_link(spark):
    """Linked sets of every small size and many large ones share a signature, at the least overlap that links them too."""
    r = np.random.default_rng(7)
    for n in [*range(1, 41), 75, 150, 400]:
        for _ in range(1500 if n < 15 else 60):
            m = n + int(r.integers(0, n // 5 + 1))
            least = jaccard_join.need(n, m, 85)
            if least > n:
                continue
            k = least if r.random() < 0.7 else int(r.integers(least, n + 1))
            tokens = r.integers(0, 2**64 - 1, n + m, dtype=np.uint64)
            a, b = np.unique(tokens[:n]), np.unique(np.concatenate([tokens[:k], tokens[n:n + m - k]]))
            assert len(np.intersect1d(jaccard_join.signatures(a, 85), jaccard_join.signatures(b, 85))), (n, m, k)
    text = "w937669 w68696 w918208 w569068 w25831 w82942 w783103 w950427 w605814"
    rows = spark.createDataFrame([(1, text), (2, text + " w876211"), (3, "other words")], "doc_id long, text string")
    assert {x["key"]: x["component"] for x in jaccard_join.jaccard_classes(rows).collect()} == {1: 1, 2: 1, 3: 3}


def test_jaccard_leaves_nothing_behind(spark):
    """Tables and folders of the steps go; what the result reads stays."""
    before = {t.name for t in spark.catalog.listTables()}
    out = jaccard_join.jaccard_classes(spark.createDataFrame([(i, f"some words that are the same {i // 2}") for i in range(8)], "doc_id long, text string"))
    assert out.count() == 8 and {t.name for t in spark.catalog.listTables()} == before


def test_shard_numbers_do_not_overflow():
    """The number of a shard holds any task and as many shards of it as a task can write."""
    part, shard = 2**31 - 1, 2**32 - 1
    assert token_table.MANIFEST.startswith("part long") and 0 < (part << 32) + shard < 2**63


def test_jaccard_sketches_permit_every_link():
    """Linked sets differ in no more bits than they may in shingles, in lists of two and of many and at widths that are folded."""
    r = np.random.default_rng(9)
    for n in [1, 2, 7, 30, 62, 63, 64, 65, 120, 127, 128, 250, 260, 900, 1100]:
        sets, linked = [], []
        for _ in range(4):
            for _ in range(3):
                m = n + int(r.integers(0, n // 6 + 1))
                least = jaccard_join.need(n, m, 85)
                if least <= n:
                    tokens = r.integers(0, 2**64 - 1, n + m, dtype=np.uint64)
                    linked.append((len(sets), len(sets) + 1))
                    sets += [np.unique(tokens[:n]), np.unique(np.concatenate([tokens[:least], tokens[n:n + m - least]]))]
        sizes, sketches = np.array([len(x) for x in sets]), [jaccard_join.sketch(x) for x in sets]
        for i, j in linked:
            assert jaccard_join._spanning(sizes[[j, i]], [sketches[j], sketches[i]], 85) == [(0, 1)]
        parent = list(range(len(sets)))
        for i, j in jaccard_join._spanning(sizes, sketches, 85):
            parent = [parent[i] if x == parent[j] else x for x in parent]
        assert all(parent[i] == parent[j] for i, j in linked)
        assert n < 30 or len(set(parent)) > 1


def test_jaccard_groups_hold_no_texts_that_share_a_line_only(spark, monkeypatch):
    """A line that many texts have gathers them in no group, however many there are; and signatures are fewer than a quarter of the shingles."""
    r, seen, dealt = random.Random(8), [], jaccard_join._dealt
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, line + " " + " ".join(f"w{r.randrange(10 ** 9)}" for _ in range(r.randint(30, 60)))) for i in range(1500)]
    rows += [(len(rows) + i, f"{t} more") for i, (_, t) in enumerate(rows[:20])]
    monkeypatch.setattr(jaccard_join, "_dealt", lambda sets, groups, *a: seen.append(groups.groupBy("gid").count().collect()) or dealt(sets, groups, *a))
    out = {x["key"]: x["component"] for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i - 1500 if i >= 1500 else i for i in range(1520)}
    assert sorted(x["count"] for x in seen[0]) == [2] * 20
    shingles = jaccard_join.Shingler()(" ".join(f"w{i}" for i in range(250)))
    assert len(jaccard_join.signatures(shingles, 85)) < len(shingles) / 4


def test_token_table_encodes_arrow_slices_as_the_library_does(monkeypatch):
    """Slices with and without odd white space, empty words between spaces, and a store that forgets words."""
    from tokenizers import Tokenizer

    path, r = P.path(token_table.VOCABULARY), random.Random(2)
    library = Tokenizer.from_file(path)
    plain = ["a", "B", "é", " ", "  ", "\n", "\x1c", ".", ",", "'s", "12", "İ", "ß", "中", "\0", "foo.", "..", ", ", "word,"]
    monkeypatch.setattr(token_table, "SLICE_BYTES", 300)
    for letters in (plain, [*plain, "\r\n", "\t", "\x85", "\xa0", "　", "᠎", "​"]):
        texts = [None, "", " ", "\n", *("".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(1000))]
        want = [struct.pack(f"<{len(x) + 1}H", *x, 1) for x in (library.encode(t or "", add_special_tokens=False).ids for t in texts)]
        assert list(token_table.encoder(path, cache_words=50)(pa.array(texts, pa.string()))) == want
