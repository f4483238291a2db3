"""LM scoring by context-tree weighting over bytes, beside a word-unigram base.

A byte is eight binary decisions. In each context, the last 0 to ``DEPTH`` bytes, and for each decision's
place among the eight, a Krichevsky-Trofimov estimate has its counts; the tree's weights mix those of all
depths. With the counts of the training texts fixed, the probability of a byte after its context is the
product of eight such mixtures, and a text's score is the sum over its bytes and its end.

Texts are dealt by hash into blocks of about ``BLOCK_BYTES``; a row that stands in the table again and again, id and
all, is one row there, with the number of its copies. A block counts its own words and
(context, byte) codes; the counts are summed over blocks. The deeper levels of the tree are built in groups of codes
that share the last two bytes of their contexts; a group of very many codes is dealt out by the last three. Nodes for two
bytes are then summed over groups, and the 65,791 nodes above them on the driver. Then each block gets back the values
of its own words and codes and scores its texts. So what is gathered grows with the corpus, while no task holds
more than a block or about ``GROUP_CODES``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.llm.store import give_back, possibly, remove, written

DEPTH = 4
BLOCK_BYTES = 20_000_000
#: Bytes that a row stands for beside its text, so that empty texts are dealt out too.
ROW_BYTES = 16
#: Copies of a row that together are larger than this part of a block are one row of it.
COPIES_SHARE = 20
#: Copies of a row that are made anew by one step of a task.
COPIES_AT_ONCE = 10_000
#: A group is dealt out if it has more codes than a GROUP_SHARE-th of all, with 1000 at least and GROUP_CODES at most.
GROUP_SHARE, GROUP_CODES = 400, 100_000
#: The share of texts that is held out: remainder 1 of the id's checksum by 5.
FOLDS, HELD_OUT = 5, 1
#: Fixed value: a byte that UTF-8 never has; it pads the first contexts and ends each text.
_EDGE = b"\xff"
#: Bytes of text whose codes, eight bytes each, are made at once.
_CHUNK_BYTES = 2_000_000
_HALF = np.log(0.5)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the checksum of the id as text, modulo FOLDS, is HELD_OUT; a null id is empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts in turn, number of each text's codes): for each byte and the end of a text the
    last ``depth`` bytes, latest first, and then the byte, as the digits of a number to the base 256."""
    data = np.frombuffer(b"".join([_EDGE * depth + t + _EDGE for t in texts]), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = data[depth:].copy() if len(data) else data
    for back in range(1, depth + 1):
        out |= data[depth - back : len(data) - back] << (8 * (depth + 1 - back))
    del data
    ends = np.cumsum(sizes + depth) - depth  # where, in out, the padding of the next text begins
    own = np.ones(len(out), bool)
    for k in range(depth):
        own[(ends + k)[:-1]] = False
    return out[own], sizes


def _chunks(texts: list[bytes]):
    """(first, last) of runs of texts of about _CHUNK_BYTES."""
    low, room = 0, 0
    for i, t in enumerate(texts):
        room += len(t)
        if room >= _CHUNK_BYTES:
            yield low, i + 1
            low, room = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _lowered(table: pa.Table) -> list[bytes]:
    return [(t or b"").lower() for t in table["text"].cast(pa.binary()).to_pylist()]  # bytes: only A-Z


def _distinct_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of texts, sorted, and their numbers; no more than these and one chunk are held."""
    found, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in _chunks(texts):
        more, counts = np.unique(codes(texts[a:b], depth)[0], return_counts=True)
        at = np.searchsorted(found, more)
        known = at < len(found)
        known[known] = found[at[known]] == more[known]
        n[at[known]] += counts[known]
        new = ~known
        if new.any():
            found, n = np.insert(found, at[new], more[new]), np.insert(n, at[new], counts[new])
    return found, n


def _summed(found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of several (codes, numbers, times), and the sums of numbers by times."""
    if len(found) == 1:
        own, n, times = found[0]
        return own, n * times
    own, inverse = np.unique(np.concatenate([c for c, _, _ in found]), return_inverse=True)
    n = np.zeros(len(own), np.int64)
    np.add.at(n, inverse, np.concatenate([k * times for _, k, times in found]))
    return own, n


_COUNTED = "block int, word binary, code long, n long"


def _count_block(table: pa.Table, depth: int) -> pa.Table:
    """The block's words (the end of a text: an empty word) and codes, with their numbers in training texts."""
    times = np.where(table["held_out"].to_numpy(), 0, table["copies"].to_numpy()).tolist()
    texts, block = _lowered(table), table["block"][0].as_py()
    del table  # its texts stand in the list
    words: Counter = Counter()
    for text, n in zip(texts, times, strict=True):
        own = text.split()
        words.update(own if n == 1 else {w: c * n for w, c in Counter(own).items()})
        words[b""] += n
    of = lambda n: [t for t, own in zip(texts, times, strict=True) if own == n]
    train, n = _summed([(*_distinct_codes(of(n), depth), n) for n in sorted({1, *times} - {0})])
    other = np.setdiff1d(_distinct_codes(of(0), depth)[0], train)
    rows = len(words) + len(train) + len(other)
    return pa.table(
        {
            "block": pa.array(np.full(rows, block, np.int32)),
            "word": pa.array([*words, *[None] * (len(train) + len(other))], pa.binary()),
            "code": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(train), pa.array(other)]),
            "n": np.concatenate([np.fromiter(words.values(), np.int64, len(words)), n, np.zeros(len(other), np.int64)]),
        }
    )


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


class _Level:
    """Nodes of one depth: sorted keys (context << 8 | place among a byte's decisions), counts and weights."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        """below: the summed log_weighted of the nodes below; none for the deepest level."""
        self.keys, self.zeros, self.ones = keys, zeros, ones
        kt = _log_kt(zeros, ones)
        self.log_weighted = kt if below is None else np.logaddexp(_HALF + kt, _HALF + below)
        #: The share of the node's own estimate in its mixture with those below.
        self.own = np.ones_like(kt) if below is None else np.exp(_HALF + kt - self.log_weighted)

    def sums(self) -> tuple[np.ndarray, ...]:
        """keys, zeros, ones and log_weighted, summed by the contexts that lack the oldest byte."""
        keys, inverse = np.unique((self.keys >> 16) << 8 | (self.keys & 255), return_inverse=True)
        return keys, *(np.bincount(inverse, w, len(keys)) for w in (self.zeros, self.ones, self.log_weighted))

    def parents(self) -> _Level:
        """The level whose contexts lack the oldest byte."""
        return _Level(*self.sums())

    def mixed(self, keys: np.ndarray, bits: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The probability of each bit at the node of each key, given that in the tree below."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not seen.any():
            return 0.5 * (0.5 + below)
        zeros, ones, own = (np.where(seen, x[at], d) for x, d in ((self.zeros, 0), (self.ones, 0), (self.own, 0.5)))
        return own * (np.where(bits, ones, zeros) + 0.5) / (zeros + ones + 1) + (1 - own) * below


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[8, codes] keys (context << 8 | place) and bits of the eight decisions on each code's byte."""
    byte = code & 255
    places = np.stack([1 << k | byte >> (8 - k) for k in range(8)])
    return (code >> 8) << 8 | places, np.stack([byte >> (7 - k) & 1 for k in range(8)])


def _deepest(code: np.ndarray, n: np.ndarray) -> _Level:
    keys, bits = _decisions(code[n > 0])
    weight = np.broadcast_to(n[n > 0].astype(float), keys.shape).ravel()
    keys, inverse = np.unique(keys.ravel(), return_inverse=True)
    ones = np.bincount(inverse, weight * bits.ravel(), len(keys))
    return _Level(keys, np.bincount(inverse, weight, len(keys)) - ones, ones, None)


def _levels(code: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[_Level]:
    """Levels of depth, depth - 1, ... least."""
    out = [_deepest(code, n)]
    for _ in range(depth - least):
        out.append(out[-1].parents())
    return out


def _score_codes(code: np.ndarray, levels: list[_Level], top: list[_Level]) -> np.ndarray:
    """log10 of the probability of each code's byte after its context; levels from the deepest up."""
    keys, bits = _decisions(code)
    probability = np.full(bits.shape, 0.5)
    for up, level in enumerate([*levels, *top]):
        own = (keys >> (8 + 8 * up)) << 8 | keys & 255
        mixed = level.mixed(own.ravel(), bits.ravel(), probability.ravel()).reshape(bits.shape)
        probability = mixed
    return np.log10(probability).sum(axis=0)


_NODES = "key long, zeros double, ones double, {}"


def tree(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, value: log10 of each byte's probability after its context, for all codes of counts (code, n; written)."""
    if depth < 3:
        raise ValueError("the depth is 3 at least")
    last = F.shiftright("code", 8 * (depth - 1))  # the last two bytes of the context
    sizes = counts.groupBy(last.alias("last")).agg(F.count(F.lit(1)).alias("codes"))  # 65,536 rows at most
    total = sizes.agg(F.coalesce(F.sum("codes"), F.lit(0))).first()[0]
    limit = min(GROUP_CODES, max(1000, total // GROUP_SHARE))
    parts = written(sizes.select("last", F.ceil(F.col("codes") / limit).cast("int").alias("parts")), "suffixes")
    part = F.pmod(F.xxhash64(F.shiftright("code", 8 * (depth - 2))), "parts").cast("int")  # by the last three bytes
    grouped = counts.withColumn("last", last).join(F.broadcast(parts), "last").select("last", part.alias("part"), "code", "n")

    def up(table: pa.Table) -> pa.Table:
        keys, zeros, ones, weighted = _levels(table["code"].to_numpy(), table["n"].to_numpy(), depth, 3)[-1].sums()
        return pa.table({"key": keys, "zeros": zeros, "ones": ones, "below": weighted})

    def mix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = _Level(*(batch.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")))
            yield pa.RecordBatch.from_pydict({"key": level.keys, "zeros": level.zeros, "ones": level.ones, "own": level.own, "weighted": level.log_weighted})

    partial = grouped.where("n > 0").groupBy("last", "part").applyInArrow(up, _NODES.format("below double"))
    summed = partial.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    two = written(summed.mapInArrow(mix, _NODES.format("own double, weighted double")), "tree-nodes")
    first = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(255))
    sums = two.groupBy(first.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
    got = sums.orderBy("key").toArrow()  # 256 contexts of 255 decisions at most
    one = _Level(*(got[c].to_numpy() for c in ("key", "zeros", "ones", "weighted")))
    top = [one, one.parents()]

    def down(table: pa.Table, nodes: pa.Table) -> pa.Table:
        code, order = table["code"].to_numpy(), np.argsort(nodes["key"].to_numpy())
        middle = _Level(*(nodes[c].to_numpy()[order] for c in ("key", "zeros", "ones")), None)
        middle.own = nodes["own"].to_numpy()[order]
        levels = _levels(code, table["n"].to_numpy(), depth, 3)
        return pa.table({"code": code, "value": _score_codes(code, levels, [middle, *top])})

    above = two.withColumn("last", F.shiftright("key", 8)).join(F.broadcast(parts), "last")
    above = above.select("last", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", "zeros", "ones", "own")
    return grouped.groupBy("last", "part").cogroup(above.groupBy("last", "part")).applyInArrow(down, "code long, value double")


_SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, copies long"


def _score_block(docs: pa.Table, values: pa.Table, depth: int, tokens: int, distinct: int) -> pa.Table:
    texts = _lowered(docs)
    is_word = values["word"].is_valid().to_numpy()
    count = values["value"].to_numpy()
    words, total = values["word"].filter(pa.array(is_word)).to_pylist(), tokens + 0.5 * (distinct + 1)
    place = {w: i for i, w in enumerate(words)}
    known, logs = count[is_word] > 0, np.log10((count[is_word] + 0.5) / total)
    code = values["code"].filter(pa.array(~is_word)).to_numpy()
    order = np.argsort(code)
    code, logp = code[order], count[~is_word][order]
    del order, count, is_word, words
    n_tokens, n_known, base, score = [], [], [], []
    for a, b in _chunks(texts):
        for text in texts[a:b]:
            own = text.split()
            own.append(b"")
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            n_tokens.append(len(own))
            n_known.append(int(known[at].sum()))
            base.append(float(logs[at].sum()))
        found, sizes = codes(texts[a:b], depth)
        score.extend(np.add.reduceat(logp[np.searchsorted(code, found)], np.cumsum(sizes) - sizes).tolist())
    return pa.table(
        [docs["doc_id"], docs["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), docs["copies"]],
        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "copies"],
    )


def _giving_back(block: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """block, after which the worker keeps no more memory than the result and its tables."""
    if block.__code__.co_argcount == 1:
        return lambda table: (block(table), give_back())[0]
    return lambda left, right: (block(left, right), give_back())[0]


def _with_copies(docs: DataFrame, counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(doc_id, text and copies, whether any may be more than 1). Rows whose copies have more than ``most`` bytes together are one row
    with their number; any other row may stand as it is. counts: row (the hash of doc_id and text), n and bytes."""
    hot = counts.where((F.col("n") > 1) & (F.col("bytes") > most)).select("row")
    if hot.first() is None:
        return docs.select("doc_id", "text", F.lit(1).cast("long").alias("copies")), False
    maybe, rest = possibly(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")), "row", hot)
    once = maybe.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))  # copies are counted before the shuffle
    return rest.select("doc_id", "text", F.lit(1).cast("long").alias("copies")).unionByName(once), True


def _copied(scored: DataFrame) -> DataFrame:
    """scored (written), each row as often as its copies say; very many copies of one row are made by several tasks."""
    many = scored.where("copies > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    dealt = many.repartition("doc_id", "from")
    upto = F.least(F.col("copies") - F.col("from"), F.lit(COPIES_AT_ONCE)).cast("int")
    return scored.where("copies = 1").unionByName(dealt.withColumn("from", F.explode(F.array_repeat(F.lit(0), upto))).drop("from"))


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs.

    Both models learn from the rows that aren't held out, with A-Z lower-cased, and score all rows whole. score
    is log10 of the probability of the lower-cased text's bytes and of its end; bits_per_byte the code length
    of those, divided by the bytes and the end. A null text is empty: one token, its end. Repeated rows
    are learnt from and scored each, also where one row is any share of the table. Columns other than doc_id and text are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    of_rows = docs.groupBy(F.xxhash64("doc_id", "text").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("bytes"))
    counts = written(of_rows, "row-counts")
    blocks = (counts.select(F.sum("bytes")).first()[0] or 0) // block_bytes + 1
    rows, copies = _with_copies(docs, counts, block_bytes // COPIES_SHARE)
    remove(counts)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    texts = rows.select("doc_id", "text", "copies", held_out().alias("held_out"), block.alias("block")).repartition(blocks, "block")
    counted = written(texts.groupBy("block").applyInArrow(_giving_back(lambda t: _count_block(t, depth)), _COUNTED), "block-counts")
    words = written(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    of_codes = counted.where("code is not null")
    sums = written(of_codes.groupBy("code").agg(F.sum("n").alias("n")), "code-counts")
    model = written(tree(sums, depth), "tree", sums)
    word_values = counted.where("word is not null").select("block", "word").join(words, "word")
    code_values = of_codes.select("block", "code").join(model, "code")
    values = word_values.select("block", "word", F.lit(None).cast("long").alias("code"), F.col("n").cast("double").alias("value")).unionByName(code_values.select("block", F.lit(None).cast("binary").alias("word"), "code", "value")).repartition(blocks, "block")
    scored = texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_giving_back(lambda d, v: _score_block(d, v, depth, tokens, distinct)), _SCORED.format(id=id_type))
    if copies:
        scored = _copied(written(scored, "scores"))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
