"""Exact near-duplicate components: n-gram Jaccard join by token-combination prefixes.

A document is its set of distinct ``SHINGLE``-word shingles, as 64-bit hashes (tokens); equal sets share one
id.  Tokens are ordered rare first: those that a list of frequent tokens doesn't name, by how frequent their words are
and then by hash, then the frequent ones by count; the counts are lower bounds, as a token counts only where a task meets it twice within ``HELD_TOKENS``.
Shingles of frequent words alone meet by chance, the more of them the larger the corpus and soon more than any list of
fixed size holds; so a shingle's place follows the product of its words' frequencies, which a short list of words gives.  Two sets with Jaccard similarity t or more share a token in the first
n - ceil(t n) + 1 tokens of each.  Prefixes are extended, so that similar sets whose
prefixes are rare throughout share many tokens there, each indexed alone, and pairs that share fewer go.  If none is rare, both sets lie in their
frequent tokens but for tokens that they don't share, and then share two frequent tokens that follow each other in both
lists: pairs of neighbours in an extended prefix of the frequent tokens are indexed as 2-token combinations
(``combination_room`` bounds how far the first shared pair can be).  So no similar pair is missed, whatever the
lists of frequent tokens and words, which only decide how much is compared.

Groups of a key turn into counted pairs up to a fixed size.  Beyond it they only count how many of a set's keys lie in
large groups: similar sets that meet in no small group share all their keys in large ones, so only sets with that many,
and sets with frequent tokens in their prefix, are linked there, by stars.  The components of what is left
are compared exactly with an inverted index of whole sets, large ones in rounds of blocks, and the links found give
the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.spans import row_key
from spanloom.llm.superkmer import _ODD, Words, _mixed, _run_hashes, _steps
from spanloom.llm.tokens import ragged
from spanloom.shared import bounded_batches, discard, give_back, sparing, written

SHINGLE = 5
FREQUENT_TOKENS = 1 << 18  #: tokens on the broadcast list of frequent ones at most, 4 MB: the most frequent
FREQUENT_WORDS = 1 << 10  #: hashes of words that a task, and in the end the list, names at most: the most frequent
WORD_BITS = 16  #: of a word's hash, which stand for it there
FREQUENT_FROM = 5  #: documents that a token must be counted in to be listed
HELD_TOKENS = 1 << 22  #: tokens that a task counts at once; it remembers those met twice or more among them
FLUSH_KEYS = 1 << 20  #: index entries that a task gathers before it sends them to their buckets
PAIRED_GROUP = 32  #: groups of one key up to this size count the keys that two sets share; larger ones are stars of the sets that need them
EXTENSION = 8  #: prefixes are extended by one token for each so many of the set
TASK_TOKENS = 1 << 18  #: tokens of the sets compared in one task, about; a larger candidate component is dealt to blocks of half as many
MERGING = 0.9  #: block rounds go on while they leave at most this share of the tokens
BLOCK_BITS = 1 << 15  #: of a block of a filter of keys: a row of 4 KB
FILTER_BLOCKS = 1 << 12  #: of a filter at most, 16 MB; one of more than 8 million keys lets more rows through to the exact join
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_numbers(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def token_sets(words: Words, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): each text's distinct shingles in order of hash; fewer words than a shingle has make one token.

    With weights, by the first bits of a word's hash, the shingles are in order of their words' total weight, then of hash.
    """
    counts = np.diff(words.first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = ragged(words.first[:-1], n)
    stop = np.minimum(at + SHINGLE, np.repeat(words.first[1:], n))
    tokens = _run_hashes(words.hashes, at, stop)
    text = np.repeat(np.arange(len(n)), n)
    place = text
    if weights is not None:
        total = np.concatenate(([0], np.cumsum(weights[_word_numbers(words)])))
        place = (text << 16) + total[stop] - total[at]
    order = np.lexsort((tokens, place))
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    tokens = tokens[new]
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(n)))))


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set: equal for equal sets; 0 for the empty set."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(tokens ^ _ODD), dtype=np.uint64)))
    sizes = np.diff(offsets).astype(np.uint64)
    ids = _mixed(total[offsets[1:]] - total[offsets[:-1]] + sizes * _ODD) >> np.uint64(1)
    return np.where(sizes > 0, np.maximum(ids, 1), 0).astype(np.int64)


def extension(n: np.ndarray) -> np.ndarray:
    """k: how many tokens two similar sets share at least in prefixes extended for it."""
    return -(-n // EXTENSION)


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    """n - ceil(t n) + k: the k-th shared token of similar sets lies no later, in either."""
    return n - -(-(n * t.numerator) // t.denominator) + extension(n)


def combination_room(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Neighbour pairs at the head of a frequent list that hold, for sets of n tokens, a pair shared with any similar set.

    Of a set's neighbour pairs, each token missing in the other breaks two and each token that the other adds breaks
    one, and the other's position is later by what it adds: 2 (n - o) + 2 (m - o) + 1 places, largest at m = n / t.
    """
    return -(-2 * n * (t.denominator - t.numerator) // t.numerator) + 2


def index_keys(tokens: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, rank: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, key) of all index entries, and which sets have frequent tokens in their prefix. frequent: sorted tokens, rank: their place by ascending count."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(frequent, tokens), max(len(frequent) - 1, 0))
    often = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    rare_before = np.cumsum(~often) - ~often
    place = rare_before - np.concatenate((rare_before, [0]))[np.minimum(offsets[:-1], max(len(tokens) - 1, 0))][owner] if len(tokens) else rare_before
    head = prefix_length(sizes, t)
    alone = ~often & (place < head[owner])
    n_rare = np.bincount(owner[~often], minlength=len(sizes))
    joint = often & (n_rare < head)[owner]
    own, tok, order = owner[joint], tokens[joint], rank[at[joint]] if len(frequent) else np.zeros(0, np.int64)
    by_rank = np.lexsort((order, own))
    own, tok = own[by_rank], tok[by_rank]
    first = np.searchsorted(own, np.arange(len(sizes)))
    number = np.arange(len(own)) - first[own]
    pair = np.zeros(len(own), bool)
    pair[:-1] = own[1:] == own[:-1]
    pair &= number < combination_room(sizes, t)[own]
    follow = np.flatnonzero(pair)
    combined = _mixed(tok[follow] * _ODD + tok[np.minimum(follow + 1, max(len(tok) - 1, 0))]) if len(tok) else tok
    return np.concatenate((owner[alone], own[follow])), np.concatenate((tokens[alone], combined)), n_rare < head


def grouped_entries(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The index entries, each once, by key, size and id, and which of them lie in groups beyond ``PAIRED_GROUP``."""
    order = np.lexsort((ids, sizes, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
    keys, ids, sizes, mixed = (c[order[new]] for c in (keys, ids, sizes, mixed))
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(begins) - 1
    return keys, ids, sizes, mixed, (np.bincount(group) > PAIRED_GROUP)[group] if len(keys) else begins


def candidate_pairs(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, mixed: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, id, shared keys, keys they must share in all) of sets that meet in a small group of one key and aren't too far apart in size.

    Two sets must share as many keys as the smaller one's extension says, as the first tokens shared lie in both
    prefixes, unless both have frequent tokens in theirs (mixed): these need share none.
    """
    keys, ids, sizes, mixed, large = grouped_entries(keys, ids, sizes, mixed)
    out = [(ids[:0], ids[:0], sizes[:0])]
    for d in range(1, PAIRED_GROUP):
        near = np.flatnonzero((keys[d:] == keys[:-d]) & ~large[d:] & (sizes[d:] * t.numerator <= sizes[:-d] * t.denominator))
        if not len(near) and d > 1:
            break
        out.append((ids[near], ids[near + d], np.where(mixed[near] & mixed[near + d], 0, extension(sizes[near]))))
    a, b, need = (np.concatenate(c) for c in zip(*out, strict=True))
    pair = np.column_stack([np.minimum(a, b), np.maximum(a, b)])
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    pair, need = pair[order], need[order]
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]).any(1)
    at = np.flatnonzero(first)
    if not len(at):
        return pair[:, 0], pair[:, 1], need, need
    return pair[at, 0], pair[at, 1], np.diff(np.append(at, len(pair))), np.minimum.reduceat(need, at)


def star_links(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """A star by size for each key: every set with the first, anew where sizes are too far apart."""
    order = np.lexsort((ids, sizes, keys))
    keys, ids, sizes = keys[order], ids[order], sizes[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] * t.numerator > sizes[:-1] * t.denominator)
    head = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
    star = np.flatnonzero(ids[head] != ids)
    pair = np.unique(np.column_stack([ids[head[star]], ids[star]]), axis=0)
    return pair[:, 0], pair[:, 1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of links a-b; the root is the least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        np.minimum.at(parent, high, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[parent]


def similar(tokens: np.ndarray, offsets: np.ndarray, t: Fraction, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, root) of every set: the first set of its label, and the first of its component once similar sets are linked.

    Sets of one label count as linked already; without labels each set has its own.  An inverted index of all tokens
    finds them: a set is compared with the later ones that share a token with it and aren't in its component yet.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(tokens, kind="stable")
    _, start, inverse, count = np.unique(tokens[order], return_index=True, return_inverse=True, return_counts=True)
    posting, token_of = owner[order], np.empty(len(tokens), np.int64)
    token_of[order] = inverse
    first = np.arange(len(sizes))
    if labels is not None:
        _, at, inverse = np.unique(labels, return_index=True, return_inverse=True)
        first = at[inverse]
    parent = first.tolist()
    label = first.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    useful = count > 1
    for k in range(len(sizes)):
        own = token_of[offsets[k] : offsets[k + 1]]
        own = own[useful[own]]
        if not len(own):
            continue
        others = posting[ragged(start[own], count[own])]
        others = others[(others > k) & (label[others] != label[k])]
        if not len(others):
            continue
        common = np.bincount(others - k)
        near = np.flatnonzero(common) + k
        overlap = common[near - k]
        union = sizes[k] + sizes[near] - overlap
        for j in near[overlap * t.denominator >= union * t.numerator].tolist():
            x, y = find(k), find(j)
            if x != y:
                low, high = min(x, y), max(x, y)
                parent[high] = low
                label[label == label[j]] = label[k]
    return first, np.array([find(k) for k in range(len(sizes))], np.int64)


_PROFILE = "doc_id long, k long, n long, id long, token long, word long, times long"


def _profile(documents: DataFrame) -> DataFrame:
    """Each document's set size and id, and, in rows with a token, how often a task has met it, if more than once; so with its most frequent words."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "k", "n", "id", "token", "word", "times")])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, n_held, seen = [], 0, set()
        met = np.zeros(1 << WORD_BITS, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            held = np.sort(np.concatenate(buffer))
            begins = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
            times = np.diff(np.append(begins, len(held)))
            often = times > 1
            tokens, times = held[begins[often]].view(np.int64), times[often]
            for k in range(0, len(tokens), 50_000):
                empty = pa.nulls(len(tokens[k : k + 50_000]), pa.int64())
                yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(tokens[k : k + 50_000]), empty, pa.array(times[k : k + 50_000])], schema=schema)

        for batch in batches:
            for begin, raw, offsets in _steps(batch.column("text")):
                words = Words(_LOWER[raw], offsets)
                met += np.bincount(_word_numbers(words), minlength=len(met))
                tokens, own = token_sets(words)
                ids = set_ids(tokens, own)
                n = len(ids)
                empty = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, n), batch.column("k").slice(begin, n), pa.array(np.diff(own)), pa.array(ids), empty, empty, empty], schema=schema)
                fresh = _fresh(ids, seen)
                buffer.append(tokens[ragged(own[:-1][fresh], np.diff(own)[fresh])])
                n_held += len(buffer[-1])
                if n_held > HELD_TOKENS:
                    yield from counted()
                    buffer, n_held = [], 0
        if n_held:
            yield from counted()
        most = np.argsort(-met, kind="stable")[:FREQUENT_WORDS]
        most = most[met[most] > 0]
        empty = pa.nulls(len(most), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(most), pa.array(met[most])], schema=schema)

    return documents.mapInArrow(sparing(measured), _PROFILE)


def _fresh(ids: np.ndarray, seen: set) -> np.ndarray:
    """Which sets a task meets for the first time (a copy adds nothing to the index); forgets beyond 200,000."""
    if len(seen) > 200_000:
        seen.clear()
    out = np.zeros(len(ids), bool)
    for k, x in enumerate(ids.tolist()):
        if x and x not in seen:
            seen.add(x)
            out[k] = True
    return out


def _frequent_list(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, each one's rank by ascending count): at most ``FREQUENT_TOKENS``."""
    counts = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT_FROM)
    table = counts.orderBy(F.desc("times"), "token").limit(FREQUENT_TOKENS).toArrow()
    tokens = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    rank = np.arange(len(tokens))[::-1]  # the list comes most frequent first
    return tokens[order], rank[order]


def _word_weights(profile: DataFrame) -> np.ndarray:
    """For each beginning of a word's hash, the logarithm of its count in eighths of a power of two; 0 if it isn't among the most frequent."""
    counts = profile.where("word IS NOT NULL").groupBy("word").agg(F.sum("times").alias("times"))
    table = counts.orderBy(F.desc("times"), "word").limit(FREQUENT_WORDS).toArrow()
    weights, times = np.zeros(1 << WORD_BITS, np.int64), table["times"].to_numpy()
    if len(times):
        weights[table["word"].to_numpy()] = 1 + np.round(8 * np.log2(times / times.min())).astype(np.int64)
    return weights


def _index(documents: DataFrame, frequent: np.ndarray, rank: np.ndarray, weights: np.ndarray, t: Fraction, buckets: int) -> DataFrame:
    """Blocks of index entries for each bucket of keys."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, ids, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = (_mixed(keys ^ np.uint64(0x5BF03635)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                rows.append({"bucket": b, "keys": keys[own].tobytes(), "ids": ids[own].tobytes(), "sizes": sizes[own].astype("<u4").tobytes()})
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for _, raw, offsets in _steps(batch.column("text")):
                tokens, own = token_sets(Words(_LOWER[raw], offsets), weights)
                ids, sizes = set_ids(tokens, own), np.diff(own)
                fresh = np.flatnonzero(_fresh(ids, seen))
                tokens, ids, sizes = tokens[ragged(own[fresh], sizes[fresh])], ids[fresh], sizes[fresh]
                owner, keys, mixed = index_keys(tokens, np.concatenate(([0], np.cumsum(sizes))), frequent, rank, t)
                held.append((keys, ids[owner], 2 * sizes[owner] + mixed[owner]))
                n += len(keys)
                if n > FLUSH_KEYS:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return documents.mapInArrow(sparing(indexed), "bucket int, keys binary, ids binary, sizes binary")


def _candidate_links(index: DataFrame, t: Fraction) -> DataFrame:
    """Pairs that share as many index keys as similar sets must, and links of large groups. sizes of the index: twice the size, odd for mixed sets.

    Keys in large groups (many) aren't counted for pairs; a pair can share no more of them than either set has.
    Sets that need links there first meet by one key each, the least, in stars; then all keys tie the heads of those, so
    a group of near copies with many keys in common makes about a row for each set, not one for each set and key.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int64()), ("need", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("mixed", pa.bool_())])

    def met(key: tuple, table: pa.Table) -> pa.Table:
        keys, ids, sizes = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("keys", "<u8"), ("ids", "<i8"), ("sizes", "<u4")))
        n, mixed = sizes.astype(np.int64) >> 1, (sizes & 1).astype(bool)
        pairs = [pa.array(c) for c in candidate_pairs(keys, ids, n, mixed, t)]
        keys, ids, n, mixed, large = grouped_entries(keys, ids, n, mixed)
        entries = [pa.array(c[large]) for c in (keys.view(np.int64), n, mixed)]
        none = lambda like, c: pa.nulls(len(like), c.type)
        found = pa.Table.from_arrays([*pairs, *(none(pairs[0], c) for c in list(schema)[4:])], schema=schema)
        rest = pa.Table.from_arrays([pa.array(ids[large]), *(none(entries[0], c) for c in list(schema)[1:4]), *entries], schema=schema)
        give_back()
        return pa.concat_tables([found, rest])

    def starred(key: tuple, table: pa.Table) -> pa.Table:
        found = star_links(*(table[c].to_numpy() for c in ("key", "u", "n")), t)
        return pa.table([pa.array(c) for c in found], schema=pa.schema(list(schema)[:2]))

    def tied(key: tuple, table: pa.Table) -> pa.Table:
        node, root = forest(*star_links(*(table[c].to_numpy() for c in ("key", "label", "n")), t))
        return pa.table([pa.array(c[node != root]) for c in (root, node)], schema=pa.schema(list(schema)[:2]))

    found = written(index.groupBy("bucket").applyInArrow(met, "u long, v long, shared long, need long, key long, n long, mixed boolean"), "met-sets")
    entries = found.where("key IS NOT NULL").select("u", "key", "n", "mixed")
    held = written(entries.groupBy("u").agg(F.count("*").alias("many"), F.first("n").alias("n"), F.first("mixed").alias("mixed"), F.min("key").alias("key")), "large-group-keys")
    least = F.ceil(F.ceil(F.col("n") * t.numerator / t.denominator) / F.lit(EXTENSION))
    starring = held.where(F.col("mixed") | (F.col("many") >= least))
    tasks = 4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")
    first = written(starring.select(task, "key", "u", "n").groupBy("task").applyInArrow(starred, "u long, v long"), "first-stars")
    labelled = entries.join(starring.select("u"), "u").join(first.select(F.col("v").alias("u"), F.col("u").alias("label")), "u", "left")
    stars = first.unionByName(labelled.select(task, "key", F.coalesce("label", "u").alias("label"), "n").groupBy("task").applyInArrow(tied, "u long, v long"))
    pairs = found.where("key IS NULL").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    many = lambda c: held.select(F.col("u").alias(c), F.col("many").alias(f"many_{c}"))
    open_ = pairs.where("shared < need").join(many("u"), "u").join(many("v"), "v").where(F.col("shared") + F.least("many_u", "many_v") >= F.col("need"))
    links = written(pairs.where("shared >= need").select("u", "v").unionByName(open_.select("u", "v")).unionByName(stars), "candidate-links")
    discard(found, held, first)
    return links


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run here gives its shuffle files back at its end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ``keys``, the others, whose key is not): the first are few more than those whose key is.

    keys: one column of longs, hashes themselves.  A Bloom filter of 16 bits a key decides, so texts that a join wouldn't
    match needn't be shuffled for it.
    """
    own = "_"
    while any(c.startswith(own) for c in rows.columns):
        own += "_"
    at, block, held, met = (own + c for c in ("at", "block", "held", "met"))
    hashed = keys.select(F.col(keys.columns[0]).alias("x"))
    blocks = min(FILTER_BLOCKS, 1 + 16 * hashed.count() // BLOCK_BITS)
    bits = lambda c: [F.shiftrightunsigned(F.xxhash64(c), n).bitwiseAND(BLOCK_BITS - 1) for n in (0, 24)]
    places = hashed.select(F.pmod("x", F.lit(blocks)).alias(block), F.explode(F.array(*bits("x"))).alias("bit"))
    table = places.groupBy(block).agg(F.bitmap_construct_agg("bit").alias(held))
    byte = lambda bit: F.conv(F.hex(F.substring(held, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    first, second = (F.getbit(byte(bit), bit.bitwiseAND(7)) == 1 for bit in bits(key))
    tested = rows.withColumn(at, F.pmod(key, F.lit(blocks))).join(F.broadcast(table), F.col(at) == F.col(block), "left")
    tested = tested.withColumn(met, F.coalesce(first & second, F.lit(False)))
    return tuple(tested.where(c).select(*(F.col(f"`{c}`") for c in rows.columns)) for c in (F.col(met), ~F.col(met)))


def _packed_sets(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, root, held, n, tokens) of every candidate set. candidates: (k, id, n, root, held): one row's key for each set.

    Texts that may be meant and keys meet by a merge join, which leaves equal rows side by side: one of them is packed.
    """
    rows, _ = split_by_keys(documents.where("text IS NOT NULL").select("k", "text"), "k", candidates.select("k"))
    rows = rows.join(candidates.hint("merge"), "k").select("k", "id", "root", "held", "text")
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("held", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column("k").to_numpy()
            new = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
            last = keys[-1] if len(keys) else last
            batch = batch.filter(pa.array(new))
            wanted = batch.column("id").to_numpy()
            for begin, raw, offsets in _steps(batch.column("text")):
                tokens, own = token_sets(Words(_LOWER[raw], offsets))
                found = set_ids(tokens, own)
                meant = np.flatnonzero(found == wanted[begin : begin + len(found)])  # two texts may have one key
                strings = pa.array([tokens[own[m] : own[m + 1]].tobytes() for m in meant.tolist()], pa.binary())
                roots, held = (batch.column(c).to_numpy()[begin + meant] for c in ("root", "held"))
                yield pa.RecordBatch.from_arrays([pa.array(found[meant]), pa.array(roots), pa.array(held), pa.array(np.diff(own)[meant]), strings], schema=schema)

    return rows.mapInArrow(sparing(packed), "id long, root long, held long, n long, tokens binary")


def _compared(sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (u, v) between the sets of each task that are similar and not of one label. sets: task, id, tokens and, if known, label."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        ids, at = np.unique(table["id"].to_numpy(), return_index=True)
        strings = table["tokens"].combine_chunks().take(pa.array(at))
        labels = table["label"].to_numpy()[at] if "label" in table.column_names else None
        sizes = strings.to_numpy(zero_copy_only=False)
        tokens = np.frombuffer(b"".join(sizes), np.uint64)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 8 for x in sizes])))
        first, root = similar(tokens, offsets, t, labels)
        own = np.flatnonzero((root != first) & (first == np.arange(len(ids))))
        out = pa.table([pa.array(ids[own]), pa.array(ids[root[own]])], schema=schema)
        give_back()
        return out

    return sets.groupBy("task").applyInArrow(compared, "u long, v long")


def _blocks(tokens: Column) -> Column:
    """Blocks that sets of so many tokens in all are dealt to."""
    return F.when(tokens <= TASK_TOKENS, 1).otherwise(F.ceil(2 * tokens / F.lit(TASK_TOKENS))).cast("int")


def _verified_links(documents: DataFrame, candidates: DataFrame, t: Fraction) -> DataFrame:
    """Links of similar sets, enough for their components. candidates: (k, id, n, root).

    Small components of candidates share tasks.  A large one is dealt to blocks that compare their own sets; the first
    set of each group found goes on to the next round, until the groups fit a task or hardly merge any more.  Then only
    sets of different groups are left to compare: the largest group's blocks with those of all others, and these with
    each other.  So a large group of copies costs work in proportion to its size.
    """
    sizes = candidates.groupBy("root").agg(F.sum("n").alias("held"))
    total, largest = sizes.agg(F.sum("held"), F.max("held")).first()
    sets = written(_packed_sets(documents, candidates.join(sizes, "root")), "candidate-tokens", codec="none")
    small = sets.where(F.col("held") <= TASK_TOKENS).withColumn("task", F.pmod(F.xxhash64("root"), F.lit(1 + 2 * int(total or 0) // TASK_TOKENS)))
    links = written(_compared(small, t), "verified-links")
    if (largest or 0) > TASK_TOKENS:
        links = links.unionByName(_large_links(sets.where(F.col("held") > TASK_TOKENS), t))
    discard(sets)
    return links


def _large_links(sets: DataFrame, t: Fraction) -> DataFrame:
    """Links of similar sets of large components. sets: (id, root, held, n, tokens)."""
    current, before, links, number = sets, None, None, 0
    while True:
        dealt = current.withColumn("task", F.xxhash64("root", F.pmod(F.xxhash64("id", F.lit(number)), _blocks(F.col("held")))))
        found, number = written(_compared(dealt, t), "block-links"), number + 1
        links = found if links is None else links.unionByName(found)
        if before is not None and not current.where(F.col("held") > TASK_TOKENS).limit(1).count():
            break
        firsts = current.join(found.select(F.col("u").alias("id")).distinct(), "id", "left_anti").drop("held")
        left = firsts.groupBy("root").agg(F.sum("n").alias("held"))
        waiting = left.agg(F.sum("held")).first()[0] or 0
        if before is not None and waiting >= MERGING * before:
            break
        before, current = waiting, firsts.join(left, "root")
    groups = components(links)
    named = sets.drop("held").join(groups.withColumnRenamed("root", "label").withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = written(named, "labelled-sets", codec="none")
    weights = named.groupBy("root", "label").agg(F.sum("n").alias("w"))
    shape = weights.groupBy("root").agg(F.count("*").alias("groups"), F.sum("w").alias("all"), F.max(F.struct("w", "label")).alias("top")).where("groups > 1")
    shape = shape.select("root", F.col("top.label").alias("top"), _blocks(F.col("top.w")).alias("over"), _blocks(F.col("all") - F.col("top.w")).alias("under"))
    open_ = named.join(shape, "root")
    is_top, b = F.col("label") == F.col("top"), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_top = F.transform(count("over"), lambda j: F.xxhash64("root", F.lit("top"), j, b("under")))
    with_rest = F.transform(count("under"), lambda j: F.xxhash64("root", F.lit("rest"), F.least(b("under"), j), F.greatest(b("under"), j)))
    tasks = F.when(is_top, F.transform(count("under"), lambda j: F.xxhash64("root", F.lit("top"), b("over"), j))).otherwise(F.concat(with_top, with_rest))
    links = links.unionByName(written(_compared(open_.select("id", "label", "tokens", F.explode(tasks).alias("task")), t), "group-links"))
    discard(named)
    return links


def near_duplicates(documents: DataFrame, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id, group_id, component_id) of every document.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles, A to Z in lower case,
    is ``threshold`` (three quarters at least) or more; component_id is the least doc_id reachable by links, group_id the
    same component by set id.  A null text, or one without words, has an empty set, is linked with nothing and keeps
    its own doc_id.  Rows without a doc_id take part like others, also as links between others, and give no component_id
    of their own; repeated rows are linked by their equal sets.  row_key is a hash of id and text.  Further columns are
    ignored; an empty table gives no rows.
    """
    if not Fraction(3, 4) <= threshold <= 1:
        raise ValueError("the combinations are proven for thresholds of three quarters and more")
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", row_key(F.col("doc_id"), F.col("text")))
    with _freeing_shuffles(spark):
        profile = written(_profile(rows), "set-profile")
        sets = profile.where("id IS NOT NULL").select("doc_id", "k", "n", "id")
        frequent, rank = _frequent_list(profile)
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        links = _candidate_links(_index(rows, frequent, rank, _word_weights(profile), threshold, buckets), threshold)
        near = components(links)
        discard(links)
        first = sets.where("id != 0").groupBy("id").agg(F.min("k").alias("k"), F.first("n").alias("n"))
        candidates = written(first.join(near, F.col("id") == F.col("node")).select("k", "id", "n", "root"), "candidate-sets")
        found = components(_verified_links(rows, candidates, threshold))
        discard(candidates)
        grouped = sets.join(found, F.col("id") == F.col("node"), "left").select("doc_id", "k", "n", "id", F.coalesce("root", "id").alias("group_id"))
        grouped = written(grouped, "set-groups")
        discard(profile)
    least = grouped.where("group_id != 0").groupBy("group_id").agg(F.min("doc_id").alias("least"))
    joined = grouped.join(least, "group_id", "left")
    return joined.select("doc_id", F.col("k").alias("row_key"), F.col("n").alias("n_shingles"), F.col("id").alias("set_id"), "group_id", F.when(F.col("group_id") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(documents: DataFrame, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """The documents, all columns, of which each component keeps one row: of those with the least doc_id (null last) that with the least key of id and text.

    Rows are told apart by id and text, so an id with several texts loses only those in another row's component; of
    equal rows of a component one stays.  Documents without words stay.
    """
    spark = documents.sparkSession
    near = near_duplicates(documents, threshold).where("group_id != 0")
    with _freeing_shuffles(spark):
        found = written(near.groupBy("group_id", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "component-rows")
        best = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best"))
        judged = written(found.join(best, "group_id").select("row_key", "rows", (F.col("row_key") == F.col("best.row_key")).alias("stays")), "judged-rows")
    discard(found)
    key = "_row_key"
    while key in documents.columns:
        key = "_" + key
    keyed = documents.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("text")))
    touched, rest = split_by_keys(keyed, key, judged.where("NOT stays OR rows > 1").select("row_key"))
    kept = touched.join(judged.where("NOT stays").select(F.col("row_key").alias(key)), key, "left_anti")
    repeated = judged.where("stays AND rows > 1").select(F.col("row_key").alias(key))
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return rest.select(*columns).unionAll(kept.select(*columns))
