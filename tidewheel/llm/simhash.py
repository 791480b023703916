"""SimHash near-duplicates, found through Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import components, drop_keys, salt, sized, sized_semi_join, slices, staged, text_buffer, texts_of, whole_groups, word_spans
from tidewheel.llm.lm import END, _mix, tokens

#: Generator polynomial of the perfect binary Golay code (23, 12, 7).
GOLAY = 0b110001110101
#: Largest bucket whose members are compared with one another; larger ones go by common neighbours.
BUCKET = 256
#: Blocks into which a fingerprint is cut, by the number of fingerprints up to which they do: more blocks make longer keys, and more of them.
SEED_PLACE = 52
#: Rows of candidate groups that a worker handles at once; shingles of a group beyond which its texts are compared by a join.
GROUP_ROWS, GROUP_SIZE = 500, 4_000_000
BLOCKS = ((4, 1 << 27), (5, 1 << 34), (6, 1 << 63))


def _remainder(value: int) -> int:
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= GOLAY << (bit - 11)
    return value


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits, of all bytes at the three byte places, and the error for each remainder."""
    single = np.array([_remainder(1 << i) for i in range(23)], np.int64)
    places = np.zeros((3, 256), np.int64)
    for place in range(3):
        for bit in range(8):
            if place * 8 + bit < 23:
                places[place][(np.arange(256) >> bit & 1).astype(bool)] ^= single[place * 8 + bit]
    error = np.zeros(2048, np.int64)
    for k in (1, 2, 3):
        for bits in combinations(range(23), k):
            error[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    return single, places, error


_SINGLE, _PLACES, _ERROR = golay_tables()


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For 23-bit words: the codeword indices (12 bits) to which the word and its 23 one-bit neighbours decode.

    Two words within one bit share an index, as each is a neighbour of the other. A word has one
    index if its codeword is within two bits, else six. Shape (n, 24), with repeats.
    """
    x = words.astype(np.int64)[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.int64)[None, :]
    syndrome = _PLACES[0][x & 255] ^ _PLACES[1][x >> 8 & 255] ^ _PLACES[2][x >> 16]
    return (x ^ _ERROR[syndrome]) >> 11


def fuzzy_keys(prints: np.ndarray, blocks: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for 64-bit fingerprints: within 3 bits of each other two of them share a key.

    By the pigeonhole principle all blocks but three are equal, and one of the two halves of the rest
    differs by one bit at most, so has a Golay index in common. A half has 23 bits at most; of the two
    halves of 24 bits that four blocks leave, one bit each stays out.
    """
    prints = prints.astype(np.uint64)
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i: (prints >> np.uint64(ends[i]) & np.uint64((1 << (ends[i + 1] - ends[i])) - 1)).astype(np.int64)
    rows, keys = [], []
    for number, rest in enumerate(combinations(range(blocks), 3)):
        same = word = np.zeros(len(prints), np.int64)
        width = 0
        for i in range(blocks):
            if i in rest:
                word, width = word << (ends[i + 1] - ends[i]) | part(i), width + ends[i + 1] - ends[i]
            else:
                same = same << (ends[i + 1] - ends[i]) | part(i)
        low = width // 2
        for half, bits in enumerate(((word >> low) >> max(0, width - low - 23), word & ((1 << min(low, 23)) - 1))):
            index = np.sort(golay_keys(bits), axis=1)
            new = np.ones(index.shape, bool)
            new[:, 1:] = index[:, 1:] != index[:, :-1]
            at, _ = np.nonzero(new)
            rows.append(at)
            keys.append((np.int64(number * 2 + half) << 46) | (same[at] << 12) | index[new])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: ASCII lower case, words joined by one space, XXH64 of each run of `shingle` words."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    starts, ends, words = word_spans(data, offsets)
    lengths = ends - starts
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(places[-1]), 32, np.uint8)
    keep = np.zeros(len(data), bool)
    if len(starts):
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        keep = np.cumsum(edge[:-1]).astype(bool)
        target = np.ones(int(places[-1]), bool)
        target[places[1:] - 1] = False
        joined[target] = data[keep]
    begin, end = places[:-1], places[1:] - 1
    first = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    shingle_doc = np.repeat(np.arange(len(words)), count)
    shingle_at = first[shingle_doc] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(shingle_at + shingle, first[shingle_doc + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], seed) for s, e in zip(begin[shingle_at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(shingle_at))
    out = np.zeros(len(words), np.uint64)
    edges = np.concatenate([[0], np.cumsum(count)])
    for d in np.flatnonzero(count):
        ones = np.zeros(64, np.int64)
        for s in range(int(edges[d]), int(edges[d + 1]), 8192):
            bits = np.unpackbits(hashes[s : min(s + 8192, edges[d + 1])].view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(0, dtype=np.int64)
        out[d] = np.packbits(ones * 2 > count[d], bitorder="little").view(np.uint64)[0]
    return out


def sha_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) of each row; a text without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = fingerprints(*text_buffer(part.column("text")), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bucket_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, src, dst = [], [], []
            for members, seed in zip(batch.column("members"), batch.column("seed").to_pylist(), strict=True):
                fp = np.sort(np.array(members.as_py(), np.int64))
                near = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= max_bits
                label = np.arange(len(fp))
                while True:
                    low = np.where(near, label[None, :], len(fp)).min(1)
                    if (low == label).all():
                        break
                    label = low
                moved = label != np.arange(len(fp))
                seeds.append(np.full(int(moved.sum()), seed, np.int32))
                src.append(fp[moved])
                dst.append(fp[label[moved]])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds or none).astype(np.int32)), pa.array(np.concatenate(src or none)), pa.array(np.concatenate(dst or none))], names=["seed", "src", "dst"])

    return run


def _around(fps: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """(seed, center, and the columns of long to keep): all 64-bit values within so many bits of each fingerprint."""
    flips = [sum(1 << b for b in places) for k in range(bits + 1) for places in combinations(range(64), k)]
    masks = np.array(flips, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                kept = [pa.array(np.repeat(part.column(c).to_numpy(), len(masks))) for c in ("seed", *keep)]
                center = pa.array((part.column("fp").to_numpy()[:, None] ^ masks[None, :]).ravel())
                yield pa.RecordBatch.from_arrays([kept[0], center, *kept[1:]], names=["seed", "center", *keep])

    return fps.select("seed", "fp", *(c for c in keep if c != "fp")).mapInArrow(run, f"seed int, center bigint, {', '.join(f'{c} bigint' for c in keep)}")


def _crowd_links(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Edges (seed, src, dst) that connect the fingerprints of a staged table (seed, fp, node: a number of its own) as all their links do.

    A link has a middle value at most half its bits, rounded down, from one end, and the rest of them from the other. First
    those within the lesser reach of one middle value are connected, at most 65 for each, to the first of them. All of them
    being one component then, what else is within the greater reach gives an edge only if it is of another component: the
    edges of a dense group are in proportion to its fingerprints, and not to its links.
    """
    inner = max_bits // 2
    one = F.struct("fp", "node")
    balls = _around(crowd, inner, ["node", "fp"]).groupBy("seed", "center").agg(F.min(one).alias("low"), F.collect_set(one).alias("all")).where(F.size("all") > 1)
    first = balls.select("seed", "low", F.explode("all").alias("one")).where("one.node <> low.node").select("seed", F.col("one.node").alias("node"), F.col("low.node").alias("low"), F.col("one.fp").alias("src"), F.col("low.fp").alias("dst"))
    first = staged(first.dropDuplicates(["node", "low"]), "inner")
    roots = components(first.select(F.col("node").alias("src"), F.col("low").alias("dst")))
    named = staged(crowd.join(roots, "node", "left").select("seed", "fp", F.coalesce("root", "node").alias("root")), "rooted")
    near = _around(named, inner, ["root"]).withColumn("inner", F.col("root"))
    met = near.unionByName(_around(named, max_bits - inner, ["root"]).withColumn("inner", F.lit(None).cast("long")))
    mixed = met.groupBy("seed", "center").agg(F.max("inner").alias("inner"), F.min("root").alias("low"), F.max("root").alias("high")).where("inner is not null and low < high")
    mixed = staged(mixed.select("seed", "center"), "mixed")
    met = sized_semi_join(met, mixed, ["seed", "center"]).groupBy("seed", "center").agg(F.max("inner").alias("a"), F.collect_set("root").alias("all"))
    other = staged(met.select("a", F.explode("all").alias("b")).where("a <> b").distinct(), "outer")
    end = lambda node, name: crowd.select("seed", F.col("node").alias(node), F.col("fp").alias(name))
    return _starred(first.select("seed", "src", "dst")).union(other.join(end("a", "src"), "a").join(end("b", "dst").drop("seed"), "b").select("seed", "src", "dst"))


def _starred(links: DataFrame) -> DataFrame:
    """Edges (seed, src, dst) of the same components: of an end's edges to lesser ones the least stays, and the others' ends
    are linked with that. In a dense group these repeat one another. An end has a few dozen lesser ones at most."""
    low = links.where("src <> dst").groupBy("seed", F.greatest("src", "dst").alias("src")).agg(F.collect_set(F.least("src", "dst")).alias("all"))
    low = low.withColumn("low", F.array_min("all")).select("seed", "src", "low", F.explode("all").alias("dst"))
    return low.select("seed", F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst")).distinct()


def near_links(fps: DataFrame, max_bits: int = 3, bucket: int = BUCKET, blocks: int | None = None) -> DataFrame:
    """Edges (seed, src, dst) that connect distinct fingerprints (fp) just as all links of at most max_bits (3 at most) do.

    If fps has a column seed (up to 1,000), only fingerprints of one seed are compared; else it is 0.
    Buckets of two are compared in the aggregation. Larger ones up to `bucket` members are gathered
    and give a spanning forest. In still larger ones no pair is formed: a link within 3 bits has a
    middle value one bit at most from one end and two at most from the other, by which they are
    connected in steps (_crowd_links), in time and edges linear in the bucket's size. The keys'
    length follows the number of fingerprints (BLOCKS), so few share one by chance.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys hold for up to 3 bits")
    fps = fps.select("seed" if "seed" in fps.columns else F.lit(0).alias("seed"), "fp")
    if blocks is None:
        count = fps.count()
        blocks = next(b for b, most in BLOCKS if count <= most)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                fp, seed = batch.column("fp").to_numpy()[s : s + 4096], batch.column("seed").to_numpy()[s : s + 4096]
                at, key = fuzzy_keys(fp.view(np.uint64), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(key | seed[at].astype(np.int64) << SEED_PLACE), pa.array(fp[at])], names=["key", "fp"])

    keys = fps.mapInArrow(spread, "key bigint, fp bigint")
    seed = F.shiftright("key", SEED_PLACE).cast("int").alias("seed")
    stats = staged(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1"), "buckets")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    links = stats.where("n = 2").where(close("src", "dst")).select(seed, "src", "dst")
    middle = stats.where(F.col("n").between(3, bucket)).select("key")
    if not middle.isEmpty():
        lists = sized_semi_join(keys, middle, ["key"]).groupBy("key").agg(F.collect_list("fp").alias("members")).select(seed, "members")
        links = links.union(lists.mapInArrow(_bucket_links(max_bits), "seed int, src bigint, dst bigint"))
    links = _starred(links)
    large = stats.where(F.col("n") > bucket).select("key")
    if not large.isEmpty():
        crowd = staged(sized_semi_join(keys, large, ["key"]).select(seed, "fp").distinct().withColumn("node", F.monotonically_increasing_id()), "crowd")
        links = links.union(_crowd_links(crowd, max_bits))
    return links.where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id that links reach).

    Null and empty texts have fingerprint 0 and link like any other; equal fingerprints always
    link; a null doc_id is never a component's id unless it has no other; repeated rows keep their
    own result rows; an empty table gives an empty result; further columns are ignored.
    """
    rows = staged(simhash(docs, id_col, text_col, shingle, seed).withColumn("salt", salt(F.col("doc_id"))), "prints")
    part = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("low"))
    groups = staged(part.groupBy("fp").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts")), "classes")
    roots = components(near_links(groups, max_bits).select("src", "dst"))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.select("fp", "root", "salts").join(lows, "root").select("fp", "component_id", F.explode("salts").alias("salt"))
    return rows.join(classes, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def word_fingerprints(data: np.ndarray, offsets: np.ndarray, seeds: int) -> np.ndarray:
    """For each text a SimHash of its set of words for each seed."""
    hashed, counts = tokens(data, offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    hashed, text = hashed[(word := hashed != END)], text[word]
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    hashed, text = hashed[new], text[new]
    out = np.zeros((len(counts), seeds), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(text)))
    for seed in range(seeds):
        with np.errstate(over="ignore"):
            bits = _mix(hashed + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15))
        ones = np.zeros((len(first), 64), np.int32)
        for s in range(0, len(text), 1 << 16):  # whole texts or parts of one, which bounds the bits that are held
            part = np.unpackbits(bits[s : s + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
            low, high = np.searchsorted(first, s, side="right") - 1, np.searchsorted(first, s + len(part))
            ones[low:high] += np.add.reduceat(part, np.maximum(first[low:high] - s, 0), axis=0, dtype=np.int32)
        out[text[first], seed] = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def word_prints(docs: DataFrame, id_col: str, text_col: str, seeds: int) -> DataFrame:
    """(doc_id, sha, fps: a fingerprint of the text's words for each seed) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = word_fingerprints(*text_buffer(part.column("text")), seeds)
                ends = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * seeds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), pa.ListArray.from_arrays(ends, pa.array(prints.view(np.int64).ravel()))], names=["doc_id", "sha", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).withColumn("sha", sha_of(F.col("text"))).mapInArrow(run, f"doc_id {kind}, sha binary, fps array<bigint>")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct runs of so many words (fewer: of the whole text; none: no hash)."""
    hashed, counts = tokens(data, offsets)
    first, out = np.cumsum(counts) - counts, []
    run = hashed.copy()
    with np.errstate(over="ignore"):
        for k in range(1, min(words, len(run))):
            run[: len(run) - k] = _mix(run[: len(run) - k] * np.uint64(0x9E3779B97F4A7C15) + hashed[k:])
    for a, n in zip(first.tolist(), (counts - 1).tolist(), strict=True):
        if n >= words:
            out.append(np.unique(run[a : a + n - words + 1]))
        else:
            out.append(np.array([hash(tuple(hashed[a : a + n].tolist())) & (2**64 - 1)] if n else [], np.uint64))
    return out


def _settled(similarity: float):
    """p of the texts that go: of each root's texts, in order, the first stays and those similar to it go; so on with the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "root", GROUP_ROWS):
            root, p = table.column("root").to_numpy(), table.column("p").to_numpy()
            lists = table.column("shingles").combine_chunks()
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat, gone = lists.flatten().to_numpy(), np.zeros(len(p), bool)
            starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(p)], strict=True):
                left = np.arange(a, b)
                while len(left) > 1:
                    lead, left = flat[ends[left[0]] : ends[left[0] + 1]], left[1:]
                    size = ends[left + 1] - ends[left]
                    values = np.concatenate([flat[ends[i] : ends[i + 1]] for i in left])
                    common = np.bincount(np.repeat(np.arange(len(left)), size), np.isin(values, lead, assume_unique=False), len(left))
                    total = len(lead) + size - common
                    near = common >= similarity * total
                    gone[left[near]] = True
                    left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(p[gone])], names=["p"])

    return run


def _goers(sets: DataFrame, similarity: float) -> DataFrame:
    """p of the texts that go, of a staged table (p, root, rank, shingles); see _settled, which does this for small roots.

    While a root's shingles are too many for one task, its first text is compared with all others by a
    salted join, those similar to it go, and the others are what is left of the root.
    """
    open_, gone = sets, []
    while True:
        sizes = staged(open_.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("size"), F.min(F.struct("rank", "p")).alias("lead")).where("n > 1"), "roots")
        large = sizes.where(F.col("size") > GROUP_SIZE)
        if large.isEmpty():
            break
        salts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
        heads = large.select("root", F.col("lead.p").alias("lead"), salts.alias("salts"))
        leads = open_.join(sized(heads).drop("root"), F.col("p") == F.col("lead")).select("root", "lead", F.col("shingles").alias("most"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        others = open_.join(sized(heads), "root").where("p <> lead").withColumn("salt", F.pmod(F.xxhash64("p"), F.col("salts")).cast("int")).drop("lead", "salts")
        common = F.size(F.array_intersect("shingles", "most"))
        near = common >= F.lit(similarity) * (F.size("shingles") + F.size("most") - common)
        judged = staged(others.join(leads.drop("lead"), ["root", "salt"]).select("p", "root", "rank", "shingles", near.alias("near")), "judged")
        gone.append(judged.where("near").select("p"))
        small = open_.join(sized(heads.select("root")), "root", "left_anti")
        open_ = staged(small.unionByName(judged.where("not near").select(*small.columns)), "open")
    many = open_.join(sized(sizes.select("root")), "root", "left_semi").select("root", "rank", "p", "shingles")
    rest = many.repartition("root").sortWithinPartitions("root", "rank").mapInArrow(_settled(similarity), "p bigint")
    for part in gone:
        rest = rest.union(part)
    return staged(rest, "goers")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = 6, max_bits: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies of rows that stay, all columns as they are.

    Candidates are components of texts that any of `seeds` fingerprints of their words links (max_bits at
    most); within a component the text of the smallest id stays, those that share `similarity` of their
    distinct runs of `words` words with it (Jaccard) go, and so on with the rest, so each text that goes is
    near one that stays. Rows are told apart by id and text: of equal texts a row of the smallest id stays,
    a null id being the largest; of repeated rows with one id and text, one stays. A null text is the
    empty one; texts without words are near one another; an empty table gives an empty result.
    """
    rows = staged(word_prints(docs, id_col, text_col, seeds).withColumn("salt", salt(F.col("doc_id"))), "prints")
    part = rows.groupBy("sha", "salt").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("low"), F.first("fps").alias("fps"))
    texts = staged(part.groupBy("sha").agg(F.min("low").alias("low"), F.first("fps").alias("fps"), F.collect_list("salt").alias("salts")).withColumn("p", F.monotonically_increasing_id()), "texts")
    prints = texts.select("p", F.posexplode("fps").alias("seed", "fp"))
    values = staged(prints.groupBy("seed", "fp").agg(F.count("*").alias("n")), "values")
    links = staged(near_links(values, max_bits), "links")
    node = lambda value: F.xxhash64("seed", value).bitwiseOR(F.lit(-(1 << 63)))  # noqa: E731  negative, while p isn't
    ends = links.select("seed", F.col("src").alias("fp")).union(links.select("seed", F.col("dst").alias("fp"))).union(values.where("n > 1").select("seed", "fp"))
    used = prints.join(ends.distinct(), ["seed", "fp"], "left_semi").select(F.col("p").alias("src"), node("fp").alias("dst"))
    found = components(links.select(node("src").alias("src"), node("dst").alias("dst")).union(used)).where("node >= 0")
    rank = F.struct(F.col("low.none"), F.col("low.doc_id"), F.col("sha")).alias("rank")
    members = staged(texts.join(found.select(F.col("node").alias("p"), "root"), "p").select("sha", "p", "root", rank), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shingle_sets(*text_buffer(part.column("text")), words)
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("p", "root", "rank")), shingles], names=["p", "root", "rank", "shingles"])

    shape = f"p bigint, root bigint, rank {members.schema['rank'].dataType.simpleString()}, shingles array<bigint>"
    candidates = texts_of(docs, id_col, text_col).select("text", sha_of(F.col("text")).alias("sha")).join(sized(members, 160), "sha")
    whole = staged(candidates.drop("sha").mapInArrow(sets, shape).dropDuplicates(["p"]), "shingles")
    gone = _goers(whole, similarity)
    fate = texts.join(gone.withColumn("gone", F.lit(True)), "p", "left").select("sha", "low", F.coalesce("gone", F.lit(False)).alias("gone"), F.explode("salts").alias("salt"))
    decided = rows.join(fate, ["sha", "salt"]).select("doc_id", "sha", (~F.col("gone") & F.col("doc_id").eqNullSafe(F.col("low.doc_id"))).alias("kept"))
    return drop_keys(docs, {"doc_id": docs[id_col], "sha": sha_of(F.coalesce(docs[text_col], F.lit("")))}, decided)
