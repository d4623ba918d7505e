"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built on the driver over blocks of at most ``block_words`` item words, so what is broadcast has a
fixed bound however many items there are; the documents stream through every block in one pass over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import table

WINDOW = 13
COVERAGE = 20  # a document is contaminated when the hit words are at least 1 / COVERAGE of its words
BLOCK_WORDS = 2_000_000
#: Bytes of UTF-8 text to word bytes: A-Z in lower case, everything of ASCII but letters and digits a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences: every state is a class of passages with the same ends."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: dict[int, list] = {}  # by state: items that have its passage of ``window`` words
        self.short: dict[int, list[tuple[int, object]]] = {}  # by state: (words, item) of whole items under a window

    def _step(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, w, known)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def build(self, items: list[tuple[object, list[bytes]]]) -> SuffixAutomaton:
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for i, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._step(last, w)
        for i, ws in coded:  # the automaton is complete, so states no longer change
            for _, s, n in self.walk(ws, min(self.window, len(ws) or 1)):
                if n == self.window:
                    got = self.items.setdefault(s, [])
                    if not got or got[-1] != i:
                        got.append(i)
                elif n == len(ws):
                    self.short.setdefault(s, []).append((n, i))
        self.lengths = sorted({n for x in self.short.values() for n, _ in x}, reverse=True)
        return self

    def walk(self, ws: list[int], cut: int) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word, cut down to ``cut`` words."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for k, w in enumerate(ws):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            if n >= cut:
                while length[link[s]] >= cut:
                    s = link[s]
                n = cut
            yield k, s, n

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (from, to) of words inside occurrences of windows, merged, and the items that occur."""
        get, link, length = self.ids.get, self.link, self.length
        known = [get(w, -1) for w in ws]
        spans: list[tuple[int, int]] = []
        found: set = set()
        start, total = 0, len(known)
        while start < total:
            if known[start] < 0:
                start += 1
                continue
            end = start
            while end < total and known[end] >= 0:
                end += 1
            if not self.lengths and end - start < self.window:
                start = end
                continue
            for k, s, n in self.walk(known[start:end], self.window):
                hit = 0
                if n == self.window:
                    hit = n
                    found.update(self.items.get(s, ()))
                if self.lengths:
                    u = s
                    while u > 0:
                        for m, i in self.short.get(u, ()):
                            if m <= n:
                                hit = max(hit, m)
                                found.add(i)
                        u = link[u]
                if hit:
                    lo, hi = start + k + 1 - hit, start + k + 1
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, hi))
            start = end
        return spans, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(text: str, ws: list[bytes], spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data, folded = text.encode("utf-8", "surrogatepass"), (text.encode("utf-8", "surrogatepass")).translate(_FOLD)
    at, ends, pos = [], [], 0
    for w in ws:
        pos = folded.index(w, pos)
        at.append(pos)
        pos += len(w)
        ends.append(pos)
    out, last = [], 0
    for lo, hi in spans:
        out.append(data[last:at[lo]])
        last = ends[hi - 1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[SuffixAutomaton]:
    """Automata of at most ``block_words`` words each (an item that is longer has one of its own)."""
    blocks, now, size = [], [], 0
    for i, text in items.select(id_col, text_col).toLocalIterator():
        ws = words(text)
        if not ws:
            continue
        if now and size + len(ws) > block_words:
            blocks.append(SuffixAutomaton(window).build(now))
            now, size = [], 0
        now.append((i, ws))
        size += len(ws)
    return [*blocks, SuffixAutomaton(window).build(now)] if now else blocks


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (ids as strings, sorted), ``contaminated`` and
    ``hit_spans`` (first word and the word after the last, per removed span); with ``clean`` also ``clean_text``, the
    text without those spans (null text: empty).

    A window is ``window`` consecutive words of an item, or a whole shorter item; a word of a document is hit if it
    lies in an occurrence of one. ``contaminated``: hits, and ``coverage`` * hits >= words. Null and empty texts have
    no words and no hits; items without words never occur; repeated items count once by id; without any item nothing
    is hit. Input columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    blocks = spark.sparkContext.broadcast(item_blocks(items, item_id, item_text, window, block_words))
    made = {"n_words": "long", "n_hit": "long", "hit_items": "array<string>", "contaminated": "boolean", "hit_spans": "array<struct<start:int,stop:int>>"}
    if clean:
        made["clean_text"] = "string"
    kept = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in made.items())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = blocks.value
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in made}
            for text in batch.column(text_at).to_pylist():
                text = text or ""
                ws = words(text)
                spans, found = [], set()
                for a in automata:
                    got, which = a.match(ws)
                    spans += got
                    found |= which
                spans = _merge(spans)
                hit = sum(hi - lo for lo, hi in spans)
                rows["n_words"].append(len(ws))
                rows["n_hit"].append(hit)
                rows["hit_items"].append(sorted(map(str, found)))
                rows["contaminated"].append(hit > 0 and coverage * hit >= len(ws))
                rows["hit_spans"].append([{"start": lo, "stop": hi} for lo, hi in spans])
                if clean:
                    rows["clean_text"].append(_cut(text, ws, spans) if spans else text)
            types = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_items": pa.list_(pa.string()), "contaminated": pa.bool_(), "hit_spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), "clean_text": pa.string()}
            cols = [batch.column(i) for i in keep_at] + [pa.array(rows[n], types[n]) for n in made]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *made])

    text_at = docs.columns.index(text_col)
    keep_at = [docs.columns.index(n) for n in names]
    return docs.mapInArrow(run, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("hit_items")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, array_to_string(w[i : i + 12], ' ') AS g, 13 AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item WHERE len(w) >= 13)
  UNION ALL SELECT item_id, array_to_string(w, ' '), len(w) FROM item WHERE len(w) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT n FROM win),
doc_win AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM doc_win JOIN win USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
