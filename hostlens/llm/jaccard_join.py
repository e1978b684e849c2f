"""N-gram Jaccard join with prefix filters under several global token orders.

A text is the set of its hashed n-grams.  Two sets of similarity t or more share a token within the first
|x| - ceil(t |x|) + 1 tokens of each, under any global order; so candidates must share one under every order used:

- *rarest first*, over the whole corpus.  The more text there is, the more single tokens are shared by chance; so here a set is read as
  *parts*: the range of hashes is cut into equal parts, fixed for a class of sizes, and the tokens that a set has in one make an element.
  Two sets with d tokens of their own differ in d parts at most, so they share one of the first d + 1 of each.  Parts of ``_HELD``
  tokens or more come first, ordered by how many documents hold them; only they are counted, and of the others a document sends no more
  than a prefix takes.  Small sets, and similarities at which a part would hold too few tokens, are read by single tokens, those with
  a hash in the lowest quarter first.  A prefix without any element that another document holds ends the search for its document.
- within a task, rarest first over all tokens of the sets at hand, then by bands of rarity with other ties, then by hash.

Documents with equal sets form one class.  Classes that share an element of that order are dealt to families (components of the
graph class - first class of each element's list), so every candidate pair lies in one family.  A family of many tokens is cut
into blocks, and each pair of blocks is a task of bounded size.  Tasks hold sets, filter and verify all pairs, and return per class how many documents it is linked
with, and a spanning forest of links, never pairs.  Components of the forest and the sums of the numbers are the result.
Where only components are asked for, pairs already connected are skipped.

Token counts are gathered per batch of documents before they are shuffled, so a token in a third of all rows is one entry
per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import Stages, batches, discard, materialize
from hostlens.llm.components import components

_BATCH_BYTES = 2 << 20
#: Elements below it are counted over the corpus: a quarter of all tokens, and the parts of ``_HELD`` tokens or more.
_COUNTED = np.uint64(1 << 62)
#: Parts for each that a prefix takes at most; tokens of a part that is counted; size up to which sets are read by single tokens.
_SLACK, _HELD, _SINGLE = 1.25, 2, 63
#: Bytes of an element that are sent to be counted: equal ones by chance only lengthen a list.
_SENT = 5
_TOKENS_PER_BUCKET = 1_000_000
#: Tokens of the sets in a block of a family.
BLOCK_TOKENS = 1_000_000
#: Candidate classes up to which their keys (24 bytes each) are broadcast; beyond, texts are shuffled to them.
BROADCAST_CLASSES = 1_000_000
_MOST = np.iinfo(np.uint16).max


def prefix_size(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that a set of similarity percent / 100 or more shares one of."""
    return np.where(np.asarray(n) > 0, n + (-percent * np.asarray(n)) // 100 + 1, 0)


def parts_of(largest: int, percent: int) -> int:
    """Parts of the sets of a class of sizes up to ``largest``; 0 if they are read by single tokens."""
    parts = int(np.ceil(_SLACK * (2 * largest * (100 - percent) // (100 + percent) + 1)))
    return parts if largest > _SINGLE and largest >= 2 * _SLACK * parts else 0


def heads_of(tokens: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """The counted elements of a set, or as many of the lowest as a prefix takes, and the size of the prefix.

    There is a list for each class of sizes (a power of two to the next) that sets of similarity ``percent`` / 100 or more and no
    fewer tokens lie in; two sets meet in that of the larger.  The classes read by single tokens have one list together.
    """
    from hostlens.llm.words import mix

    n, out, single = len(tokens), [], False
    largest = 100 * n // percent
    mixed = None
    for k in range(n.bit_length() - 1, largest.bit_length()) if n else ():
        last = (2 << k) - 1
        parts = parts_of(last, percent)
        if not parts:
            single = True
            continue
        room = (n + min(largest, last)) * (100 - percent) // (100 + percent) + 1
        mixed = mix(tokens ^ _COUNTED) if mixed is None else mixed
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        held = np.diff(np.r_[starts, n])
        found = mix(np.add.reduceat(mixed, starts) + np.uint64(k)) >> np.uint64(2)
        found |= np.maximum(_HELD - held, 0).astype(np.uint64) << np.uint64(62)
        if len(found) < room:  # parts without tokens come last
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part)
            found = np.r_[found, mix(empty + np.uint64(parts << 32)) | np.uint64(3 << 62)]
        found.sort()
        out.append((found[: max(int(np.searchsorted(found, _COUNTED)), room)], room))
    if single:
        room = int(prefix_size(n, percent))
        out.append((tokens[: max(int(np.searchsorted(tokens, _COUNTED)), room)], room))
    return out


def _sets(texts: list[str], n: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sets and their digests."""
    from hostlens.llm.words import shingle_sets

    sets = shingle_sets(texts, n)
    return sets, [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SENT].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _SENT, 8), np.uint8)
    out[:, :_SENT] = np.frombuffer(data, np.uint8).reshape(-1, _SENT)
    return out.view("<u8").ravel()


def _by_bucket(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order of bucket, how often each occurs, where each bucket begins, and where each token went."""
    distinct, which, count = np.unique(tokens, return_inverse=True, return_counts=True)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return distinct[order], count[order], edges, place[which]


def digest(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per batch of documents: ids, text keys, set sizes, set digests, and their lists: documents, prefixes, sizes and elements."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches(source, _BATCH_BYTES, "text")):
            sets, keys = _sets([t or "" for t in batch.column("text").to_pylist()], n)
            heads = [(d, *x) for d, tokens in enumerate(sets) for x in heads_of(tokens, percent)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + i], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("tk").to_pylist()], pa.list_(pa.int64())), pa.array([[len(x) for x in sets]], pa.list_(pa.int64())),
                    pa.array([keys], pa.list_(pa.binary())),
                    *[pa.array([np.array(c, "<i4").tobytes()], pa.binary()) for c in ([d for d, _, _ in heads], [room for _, _, room in heads], [len(x) for _, x, _ in heads])],
                    pa.array([b"".join(x.tobytes() for _, x, _ in heads)], pa.binary()),
                ],
                ["batch", "doc_id", "tk", "n", "cid", "docs", "rooms", "sizes", "tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("tk"))
    return rows.mapInArrow(run, "batch long, doc_id array<long>, tk array<long>, n array<long>, cid array<binary>, docs binary, rooms binary, sizes binary, tokens binary")


def text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _distinct_heads(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists of the batch's classes: the places of their documents, their prefixes and sizes, and their elements."""
    places: dict[bytes, int] = {}
    for i, cid in enumerate(row["cid"]):
        places.setdefault(cid, i)
    first = np.zeros(len(row["cid"]), bool)
    first[list(places.values())] = True
    docs, rooms, sizes = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("docs", "rooms", "sizes"))
    own = first[docs]
    return docs[own], rooms[own], sizes[own], np.frombuffer(row["tokens"], "<u8")[np.repeat(own, sizes)]


def frequencies(heads: DataFrame, buckets: int) -> DataFrame:
    """``batch, found``: for each batch and bucket, how many documents of all batches hold each of its tokens."""

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                tokens, count, edges, _ = _by_bucket(_distinct_heads(row)[3], buckets)
                own = [i for i in range(buckets) if edges[i] < edges[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int32()), pa.array([row["batch"]] * len(own), pa.int64()),
                        pa.array([_packed(tokens[edges[i] : edges[i + 1]]) for i in own], pa.binary()),
                        pa.array([np.minimum(count[edges[i] : edges[i + 1]], _MOST).astype("<u2").tobytes() for i in own], pa.binary()),
                    ],
                    ["bucket", "batch", "tokens", "counts"],
                )

    def answer(group: pa.Table) -> pa.Table:
        tokens = [_unpacked(x) for x in group.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in group.column("counts").to_pylist()])
        distinct, which = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct))
        found = np.minimum(total, _MOST).astype("<u2")[which]
        edges = np.cumsum([len(x) for x in tokens])[:-1]
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "found": pa.array([x.tobytes() for x in np.split(found, edges)], pa.binary())})

    sent = heads.select("batch", "cid", "docs", "rooms", "sizes", "tokens").mapInArrow(send, "bucket int, batch long, tokens binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, found binary")
    return answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "found"))).alias("found"))


def postings(heads: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """``token, cid, tk, n``: elements of prefixes that several documents hold, with the classes that have them in a prefix."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                docs, rooms, sizes, tokens = _distinct_heads(row)
                _, _, edges, place = _by_bucket(tokens, buckets)
                counts = np.zeros(edges[-1], np.int64)
                for x in row["found"]:
                    counts[edges[x["bucket"]] : edges[x["bucket"] + 1]] = np.frombuffer(x["found"], "<u2")
                count = counts[place]
                which = np.repeat(np.arange(len(docs)), sizes)
                late = tokens >= _COUNTED
                order = np.lexsort((tokens, np.where(late, 0, count), late, which))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = order[(rank < rooms[which]) & (count[order] > 1)]
                doc = docs[which[keep]]
                raw = [row["cid"][i] for i in doc.tolist()]
                tk, n = (np.array(row[c], np.int64)[doc] for c in ("tk", "n"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[keep].astype(np.int64)), pa.array(raw, pa.binary()), pa.array(tk, pa.int64()), pa.array(n, pa.int64())],
                    ["token", "cid", "tk", "n"],
                )

    rows = heads.select("batch", "tk", "n", "cid", "docs", "rooms", "sizes", "tokens").join(found, "batch")
    return rows.mapInArrow(run, "token long, cid binary, tk long, n long")


def _hits(values: np.ndarray, edges: np.ndarray, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the sets ``at``, in order, how many of its values are flagged."""
    low, sizes = edges[at], edges[at + 1] - edges[at]
    if 4 * sizes.sum() > edges[at[-1] + 1] - low[0]:  # read the whole stretch
        found = flags[values[low[0] : edges[at[-1] + 1]]]
        begin = low - low[0]
    else:
        begin = np.cumsum(sizes) - sizes
        found = flags[values[np.arange(sizes.sum()) + np.repeat(low - begin, sizes)]]
    total = np.zeros(len(found) + 1, np.int32)
    np.cumsum(found, out=total[1:])
    return total[begin + sizes] - total[begin]


def linked(keys: list[bytes], sets: list[np.ndarray], side: np.ndarray, percent: int, copies: np.ndarray | None = None) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """A spanning forest of the links between distinct sets, and the copies of the sets that each is linked with.

    With two sides, of links from the first to the other, whose sets come last.  Without ``copies`` nothing is counted, and pairs
    already connected are skipped.
    """
    from hostlens.llm.words import mix

    sizes = np.array([len(x) for x in sets], np.int64)
    number = np.zeros(len(sets), np.int64)
    if not len(sets) or not sizes.sum():
        return [], number
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    edges = np.r_[0, np.cumsum(sizes)]
    _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    count = counts[which]
    room = np.repeat(prefix_size(sizes, percent), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    band = np.log2(count).astype(np.int64)
    prefixes = []
    for order in (np.lexsort((flat, count, doc)), np.lexsort((mix(flat), band, doc)), np.arange(len(flat))):
        keep = order[place < room]
        keep = keep[count[keep] > 1]
        prefixes.append((which[keep], np.searchsorted(doc[keep], np.arange(len(sets) + 1))))
    first, bounds = prefixes[0]
    holder = np.repeat(np.arange(len(sets)), np.diff(bounds))
    by_token = np.argsort(first, kind="stable")
    holders = holder[by_token]
    lists = np.searchsorted(first[by_token], np.arange(len(counts) + 1))
    flags = np.zeros(len(counts), bool)
    group = np.arange(len(sets))
    links = []
    split = int(np.argmax(side)) if side.any() and not side.all() else 0

    def holding(values: np.ndarray, edges: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        flags[own] = True
        hits = _hits(values, edges, flags, at)
        flags[own] = False
        return hits

    for x in range(split or len(sets)):
        low = max(x + 1, split)
        own = first[bounds[x] : bounds[x + 1]]
        if low == len(sets) or not len(own):
            continue
        if (lists[own + 1] - lists[own]).sum() > len(first) - bounds[low]:
            at = np.arange(low, len(sets))
            at = at[holding(first, bounds, own, at) > 0]
        else:
            at = np.unique(np.concatenate([holders[lists[t] : lists[t + 1]] for t in own.tolist()]))
            at = at[at >= low]
        at = at[100 * np.minimum(sizes[at], sizes[x]) >= percent * np.maximum(sizes[at], sizes[x])]
        if copies is None:
            at = at[group[at] != group[x]]
        for values, where in prefixes[1:]:
            if len(at):
                at = at[holding(values, where, values[where[x] : where[x + 1]], at) > 0]
        if not len(at):
            continue
        both = holding(which, edges, which[edges[x] : edges[x + 1]], at).astype(np.int64)
        at = at[100 * both >= percent * (sizes[x] + sizes[at] - both)]
        if copies is not None:
            number[x] += copies[at].sum()
            number[at] += copies[x]
        fresh, one = np.unique(group[at], return_index=True)
        for g, y in zip(fresh.tolist(), at[one].tolist()):
            if g != group[x]:
                links.append((keys[x], keys[y]))
                group[group == g] = group[x]
    return links, number


def _verify(percent: int, counted: bool):
    def run(table: pa.Table) -> pa.Table:
        found: dict[bytes, tuple[bool, bytes, int]] = {}
        for cid, data, side, copies in zip(*(table.column(c).to_pylist() for c in ("cid", "tokens", "side", "copies"))):
            found[cid] = (side, data, copies)
        keys = sorted(found, key=lambda k: (found[k][0], k))
        sets, side = [np.frombuffer(found[k][1], "<u8") for k in keys], np.array([found[k][0] for k in keys], bool)
        links, number = linked(keys, sets, side, percent, np.array([found[k][2] for k in keys], np.int64) if counted else None)
        some = np.flatnonzero(number).tolist()
        return pa.table({
            "a": pa.array([x for x, _ in links] + [keys[i] for i in some], pa.binary()), "b": pa.array([y for _, y in links] + [None] * len(some), pa.binary()),
            "n": pa.array([0] * len(links) + number[some].tolist(), pa.int64()),
        })

    return run


def links(docs: DataFrame, heads: DataFrame, n: int, percent: int, counted: bool = True) -> DataFrame:
    """``a, b, n``: links between classes that connect every component of similar documents; without ``b``, how many documents
    of other classes a task found ``a`` linked with."""
    total = heads.agg(F.sum(F.length("tokens"))).head()[0] or 0
    buckets = max(1, -(-int(total) // (8 * _TOKENS_PER_BUCKET)))
    posted = materialize(postings(heads, frequencies(heads, buckets), buckets), "join-postings")
    lists = posted.groupBy("token").agg(F.min("cid").alias("leader"), F.max("cid").alias("other")).where("leader <> other").select("token", "leader")
    stars = posted.join(lists, "token").where("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct()
    family = components(stars)
    classes = posted.groupBy("cid").agg(F.min("tk").alias("tk"), F.max("n").alias("n"))
    classes = classes.join(heads.select(F.explode("cid").alias("cid")).groupBy("cid").agg(F.count("*").alias("copies")), "cid")
    members = materialize(classes.join(family.withColumnRenamed("v", "cid"), "cid").withColumnRenamed("c", "family"), "join-members")
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    wanted = members.join(sizes, "family").select("tk", "cid", "copies", "family", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))
    if members.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("text").cast("string").alias("text"), text_key().alias("tk")).join(wanted, "tk")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # classes of this task
        for batch in batches(source, _BATCH_BYTES, "text"):
            fresh = [i for i, c in enumerate(batch.column("cid").to_pylist()) if c not in seen and not seen.add(c)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            sets, keys = _sets([t or "" for t in batch.column("text").to_pylist()], n)
            right = [i for i, c in enumerate(batch.column("cid").to_pylist()) if c == keys[i]]
            out = batch.select(["cid", "copies", "family", "blocks", "block"]).take(pa.array(right, pa.int64()))
            yield out.append_column("tokens", pa.array([sets[i].tobytes() for i in right], pa.binary()))

    sets = texts.select("text", "cid", "copies", "family", "blocks", "block").mapInArrow(run, "cid binary, copies long, family binary, blocks int, block int, tokens binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).alias("side")))
    dealt = sets.select("cid", "copies", "family", "tokens", F.inline(pairs))
    return dealt.groupBy("family", "i", "j").applyInArrow(_verify(percent, counted), "a binary, b binary, n long")


def similar(docs: DataFrame, n: int = 5, percent: int = 80, counted: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, tk, cid`` of every document.

    Words are runs of characters other than ASCII white space, with A-Z lowered.  Sets of similarity ``percent`` / 100 or more
    are linked; ``component_id`` is the smallest ``doc_id`` that links reach.  Null, empty and blank texts have no
    n-grams, are linked with nothing and keep their own id.  Rows with equal ids are documents of their own; null
    ids are reached, but name a component only if it has no other.  ``n_links`` is the number of other documents
    that a document is linked with itself, documents of the same set included; null if not ``counted``.  ``tk`` is the key of the
    text, ``cid`` the digest of the set.
    """
    with Stages() as own:
        heads = materialize(digest(docs, n, percent), "join-heads")
        with Stages() as inner:
            found = inner.result(links(docs, heads, n, percent, counted), "join-links")
        rows = own.result(heads.select(F.inline(F.arrays_zip("doc_id", "tk", F.col("n").alias("n_shingles"), "cid"))), "join-rows")
        discard(heads)
        joined = own.result(components(found.where("b is not null").select("a", "b")), "join-components")
        found = own.result(found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n")), "join-numbers")
    classes = rows.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = classes.join(joined.withColumnRenamed("v", "cid"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    lowest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = named.join(lowest, "c").select("cid", "component_id", "copies")
    if counted:
        ids = ids.join(found, "cid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    else:
        ids = ids.withColumn("n_links", F.lit(None).cast("long"))
    whole = rows.where("n_shingles > 0").join(ids, "cid")
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0 if counted else None).cast("long"))
    columns = ["doc_id", "n_shingles", "component_id", "n_links", "tk", "cid"]
    return whole.select(columns).unionAll(alone.select(columns))


def same_id(column: Column) -> list[Column]:
    """Two columns without nulls that are equal where ids are equal or both are null."""
    return [column.isNull().alias("no_id"), F.coalesce(column, F.lit(0)).alias("id")]


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row of the smallest id, of its texts any one.

    Texts without n-grams all stay.  Columns stay as they are, whatever their names.
    """
    with Stages() as own:
        found = similar(docs, n, percent, counted=False)
        linked_rows = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tk")).alias("first"))
        keepers = own.result(linked_rows.select(*same_id(F.col("first.doc_id")), F.col("first.tk").alias("tk")), "join-keepers")
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *same_id(F.col("doc_id").cast("long")), text_key().alias("tk"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    key = ["no_id", "id", "tk"]  # without nulls, so that the join and the duplicates after it need one shuffle
    once = nested.where("worded").join(keepers, key, "left_semi").dropDuplicates(key)
    return once.select("doc.*").unionAll(nested.where("worded is null or not worded").select("doc.*"))
