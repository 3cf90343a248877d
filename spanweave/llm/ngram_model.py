"""Language-model scores of whole texts by a trigram model in shards of Elias-Fano tries.

Texts are cut into batches of tokens (see tokenise). A batch asks once for each of its distinct words and n-grams, however often it
holds them, and is answered in the order in which it asked, so no answer carries its question, and a word or n-gram that a
third of all texts share costs one row a batch. Shards are dealt by context; contexts too frequent for one shard are split by
the word that follows, and their totals are added up. A shard merges the training counts of all batches, builds its trie, and
answers them from it.

The model is P(c | a b) = n(abc) / (N + T) + T / (N + T) * P(c | b), with N and T of the context a b, likewise down to the words
(Witten-Bell), whose estimate is the base's, (c + 0.5) / (N + 0.5 * (V + 1)). Nothing is left out of it: it grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import utf8
from .common import discard, stage
from .ngram_trie import Trie, build, value

#: Not words, as they are empty or a space: what stands before a text's first word, and its end, which counts as a token.
START, END = b"", b" "
#: Global word numbers stay below this, those of one batch below 2^BITS.
WORDS, BITS = 1 << 31, 21
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True


def _pieces(data: np.ndarray, lo: int, hi: int, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of data[lo:hi], A-Z in lower case, from about `size` bytes at a time."""
    while lo < hi:
        end = min(lo + size, hi)
        while end < hi and not (gap := _GAPS[data[end : end + 4096]]).any():
            end = min(end + 4096, hi)
        end = end + int(gap.argmax()) if end < hi else hi
        yield data[lo:end].tobytes().lower().split()
        lo = end


class _Batch:
    """Tokens of consecutive texts by the batch's own word numbers; START has number 0."""

    def __init__(self):
        self.words, self.tokens, self.rows, self.lead, self.n = {START: 0}, [], [], [0, 0], 0

    def add(self, words: list[bytes]) -> np.ndarray:
        d = self.words
        return np.array([d.setdefault(w, len(d)) for w in words], np.int32)

    def row(self, number: int) -> dict:
        sizes = [len(t) for t in self.tokens]
        stream = np.concatenate(self.tokens)
        trained = np.repeat([not held for _, _, held in self.rows], sizes)
        counts = np.bincount(stream[trained], minlength=len(self.words))
        keys, ids, held = zip(*self.rows, strict=True)
        words = list(self.words)
        order = np.argsort(np.array([zlib.crc32(w) for w in words[1:]], np.uint32), kind="stable").astype(np.int32) + 1
        joined = zstandard.compress(b"\n".join([words[k] for k in order.tolist()]), 1)
        return {"batch": number, "key": keys, "id": ids, "held_out": held, "size": sizes, "lead": self.lead, "word": joined, "n": _bytes(counts[order].astype(np.int32)), "order": _bytes(order), "stream": _bytes(stream)}


def tokenise(docs: DataFrame, held_out: Column, id_col: str, text_col: str, batch_tokens: int) -> DataFrame:
    """One row a batch of at most batch_tokens tokens: the pieces of texts that it holds (key tells the texts apart), its words by
    their CRC with their training counts, and the tokens as numbers of these words (order tells the number of each). A longer
    text goes on in the next batch, whose lead holds the two words before it."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"batch long, key array<bigint>, id array<{kind}>, held_out array<boolean>, size array<int>, lead array<int>, word binary, n binary, `order` binary, stream binary"
    rows = docs.select(docs[id_col].alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << 33
        now, schema = _Batch(), None

        def full(t: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(t), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(now.row(number).values(), kinds, strict=True)], names=["batch", "key", "id", "held_out", "size", "lead", "word", "n", "order", "stream"])

        for b in batches:
            schema, ids, held = b.column(0).type, b.column(0).to_pylist(), b.column(1).to_pylist()
            data, at = utf8(b.column(2))
            for i in range(b.num_rows):
                begun = False
                for words in (*_pieces(data, int(at[i]), int(at[i + 1])), [END]):
                    while words:
                        room = batch_tokens - now.n
                        some, words = words[:room], words[room:]
                        tokens = now.add(some)
                        if begun:
                            now.tokens[-1] = np.concatenate([now.tokens[-1], tokens])
                        else:
                            now.tokens.append(tokens)
                            now.rows.append((first, ids[i], held[i]))
                            begun = True
                        now.n += len(some)
                        if now.n >= batch_tokens:
                            yield full(schema)
                            names, lead = list(now.words), [now.lead, [0, 0]][len(now.rows) > 1] + now.tokens[-1][-2:].tolist()
                            now, number, begun = _Batch(), number + 1, False
                            if words or some != [END]:  # the text goes on
                                now.lead = now.add([names[k] for k in lead[-2:]]).tolist()
                first += 1
        if now.n:
            yield full(schema)

    return rows.mapInArrow(run, out)


def _bytes(a: np.ndarray) -> bytes:
    """An integer array, compressed plane by plane."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _ints(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).tobytes(), dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, for dealing."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Corpus:
    """What holds for the whole corpus: training tokens, distinct training words, training texts, shards, the most of one context in a shard."""

    def __init__(self, tokens: int, words: int, texts: int, shards: int, hot: int):
        self.tokens, self.words, self.texts, self.shards, self.hot = tokens, words, texts, shards, hot

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.words + 1))


class Questions:
    """The distinct bigrams and trigrams of a batch's tokens, in the order of their shards.

    word holds the global numbers of the batch's words, ascending, cnt their training counts. Contexts of one word have a = 0,
    others the first word's number and one.
    """

    def __init__(self, row: dict, corpus: Corpus, counted: bool):
        size, word = np.array(row["size"], np.int64), _ints(row["word"], np.int64)
        order = np.argsort(word)
        place = np.argsort(order)
        self.word, self.cnt = word[order], _ints(row["cnt"], np.int64)[order]
        stream, lead = place[_ints(row["stream"], np.int32)], place[row["lead"]]
        grams = self._grams(stream, lead, size)
        keys, where = np.unique(grams, return_inverse=True)
        n3 = np.zeros(len(keys), np.int64)
        if counted:
            n3 = np.bincount(where[np.repeat(~np.array(row["held_out"]), size)], minlength=len(keys))
        else:
            self.where = where.astype(np.int32)
        del grams, where, stream
        low = (1 << BITS) - 1
        pairs, of_pair = np.unique(keys & ((1 << 2 * BITS) - 1), return_inverse=True)
        self.of_pair = of_pair.astype(np.int32)
        n2 = np.bincount(of_pair, weights=n3, minlength=len(pairs))
        self.n = np.concatenate([n2, n3]).astype(np.uint32)
        self.word2 = (pairs & low).astype(np.int32)
        self.c = np.concatenate([self.word[self.word2], self.word[keys & low]]).astype(np.uint32)
        # contexts: of one word first, then of two
        u2, at2 = np.unique(pairs >> BITS, return_inverse=True)
        u3, at3 = np.unique(keys >> BITS, return_inverse=True)
        self.ctx = np.concatenate([at2, at3 + len(u2)]).astype(np.int32)
        del pairs, of_pair, keys, n2, n3, at2, at3
        b, two = np.concatenate([u2, u3 & low]), np.arange(len(u2) + len(u3)) >= len(u2)
        a = np.concatenate([np.zeros(len(u2), np.int64), u3 >> BITS])
        seen = np.where(self.cnt < 0, corpus.texts, self.cnt)  # of START: how many texts begin
        self.a, self.b = np.where(two, self.word[a] + 1, 0), self.word[b]
        often = np.where(two, np.minimum(seen[a], seen[b]), seen[b])
        # a pair of words is split only if each of them is a 64th of all tokens; then it may be that frequent itself
        often[two & (often * 64 < corpus.tokens)] = 0
        parts = np.maximum(1, -(-often // corpus.hot))
        self.split = parts > 1
        home, part = _mix(self.a * WORDS + self.b)[self.ctx], np.zeros(len(self.c), np.uint64)
        some = np.flatnonzero(self.split[self.ctx])
        part[some] = _mix(self.c[some]) % parts[self.ctx[some]].astype(np.uint64)
        shard = (_mix(home + part) % np.uint64(corpus.shards)).astype(np.uint32)
        del home, part
        self.order = np.argsort(shard, kind="stable").astype(np.int32)
        self.shards, self.first = np.unique(shard[self.order], return_index=True)

    @staticmethod
    def _grams(stream: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each token with the two before it; START, 0, stands before a text's first."""
        start = np.cumsum(size) - size
        one, two = np.roll(stream, 1), np.roll(stream, 2)
        one[start], two[start], two[start[size > 1] + 1] = 0, 0, 0
        one[0], two[0] = lead[1], lead[0]
        if size[0] > 1:
            two[1] = lead[1]
        return two << 2 * BITS | one << BITS | stream

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its questions in order, where runs of one context begin among them)."""
        for shard, part in zip(self.shards.tolist(), np.split(self.order, self.first[1:]), strict=True):
            ctx = self.ctx[part]
            yield shard, part, np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))

    def asked(self, part: np.ndarray, runs: np.ndarray) -> bytes:
        ctx = self.ctx[part][runs]
        arrays = np.diff(self.a[ctx], prepend=0).astype(np.uint32), self.b[ctx] << 1 | self.split[ctx], np.diff(np.append(runs, len(part))).astype(np.uint32), self.c[part], self.n[part]
        parts = [_bytes(x) for x in arrays]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _question(data: bytes) -> tuple[np.ndarray, ...]:
    sizes, at, out = np.frombuffer(data, np.int64, 5).tolist(), 40, []
    for size, dtype in zip(sizes, (np.uint32, np.int64, np.uint32, np.uint32, np.uint32), strict=True):
        out.append(_ints(data[at : at + size], dtype).astype(np.int64))
        at += size
    return (np.cumsum(out[0]), *out[1:])


def _answer(shard: tuple, asked: pa.Table) -> pa.Table:
    """One shard: its trie from all batches' counts, then each batch's codes; and the totals of the split contexts that it holds."""
    questions = [_question(q.as_py()) for q in asked.column("asked")]
    a, b, runs, c, n = (np.concatenate(x) for x in zip(*questions, strict=True))
    contexts, back = np.unique(a * WORDS + (b >> 1), return_inverse=True)
    split = np.zeros(len(contexts), bool)
    split[back] = (b & 1) > 0
    keys, at = np.unique(np.repeat(back, runs) << 32 | c, return_inverse=True)
    count = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
    own, word, learned = keys >> 32, keys & ((1 << 32) - 1), count > 0
    levels, held, total, kinds = build(contexts[own[learned]], word[learned], count[learned], split[own[learned]])
    codes, weights = Trie(levels).find(contexts, own, word)
    codes = codes[at]
    ends, firsts = np.cumsum([len(q[3]) for q in questions]), np.cumsum([len(q[2]) for q in questions])
    answers = [_pair(codes[e - len(q[3]) : e], weights[back[f - len(q[2]) : f]]) for q, e, f in zip(questions, ends, firsts, strict=True)]
    hot = np.isin(held, contexts[split])
    totals = {"context": held[hot], "total": total[hot], "kinds": kinds[hot]}
    lists = {k: pa.array([None] * len(answers) + [v.tolist()], pa.list_(pa.int64())) for k, v in totals.items()}
    return pa.table({"batch": pa.array(asked.column("batch").to_pylist() + [None], pa.int64()), "shard": pa.array([shard[0].as_py()] * (len(answers) + 1), pa.int64()), "codes": pa.array([*answers, None], pa.binary()), **lists})


def _pair(codes: np.ndarray, weights: np.ndarray) -> bytes:
    first = _bytes(codes)
    return len(first).to_bytes(8, "little") + first + _bytes(weights)


def _scored(row: dict, answers: dict[int, bytes], corpus: Corpus, totals: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The log10 probability of each of a batch's pieces."""
    q = Questions(row, corpus, counted=False)
    code, weight = np.zeros(len(q.c), np.uint16), np.ones(len(q.a), np.uint16)
    for shard, part, runs in q.each():
        data = answers[shard]
        size = int.from_bytes(data[:8], "little")
        code[part] = _ints(data[8 : 8 + size], np.uint16)
        weight[q.ctx[part[runs]]] = _ints(data[8 + size :], np.uint16)
    p, w = value(code), value(weight)
    hot = np.flatnonzero(q.split)
    if len(hot):
        held, total, kinds = totals
        at = np.minimum(np.searchsorted(held, q.a[hot] * WORDS + q.b[hot]), max(0, len(held) - 1))
        there = held[at] == q.a[hot] * WORDS + q.b[hot] if len(held) else np.zeros(len(hot), bool)
        scale, w[hot] = np.zeros(len(w)), 1.0
        scale[hot[there]] = 1e15 / (total + kinds)[at[there]]
        w[hot[there]] = (kinds / (total + kinds))[at[there]]
        p = np.where(q.split[q.ctx], p * scale[q.ctx], p)
    n2 = len(q.word2)
    p2 = p[:n2] + w[q.ctx[:n2]] * corpus.unigram(np.maximum(q.cnt, 0))[q.word2]
    p3 = p[n2:] + w[q.ctx[n2:]] * p2[q.of_pair]
    size = np.array(row["size"], np.int64)
    return np.add.reduceat(np.log10(p3)[q.where], np.cumsum(size) - size)


def score(docs: DataFrame, folds: int = 5, batch_tokens: int = 1 << 19, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A row is held out from learning if crc32 of its id as text, modulo `folds`, is 1 (a null id: the empty text). Tokens are the
    lower-cased words and one end. base_score takes each token's count alone; score is the trigram model's log10 probability,
    summed over the tokens. Probabilities are quantised within 0.12 percent and do not depend on how texts are dealt.

    batch_tokens bounds what a task holds of texts, shard_tokens what a shard holds for one context and, on average, of all;
    raise both with the executors' memory, as each batch asks each shard. A pair of words that are a 64th of all tokens each is
    split too; any other pair's continuations are in one shard. Rows of split contexts, at most tokens / shard_tokens words and
    64 * 64 pairs, are broadcast.
    Nulls: a null or empty text is one token, the end. Repeated rows and ids count each. Without a row to learn from, every word
    is unknown. An empty table gives no rows. Further columns are not read.
    """
    if not 16 <= batch_tokens < 1 << BITS:
        raise ValueError(f"a batch has 16 to 2^{BITS} tokens")
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % folds == 1
    tokens = stage(tokenise(docs, held, id_col, text_col, batch_tokens), "tokens")
    kind = tokens.schema["id"].dataType.elementType.simpleString()
    every = tokens.select(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).first().n
    if every is None:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    # words first: each shard numbers those of its range of CRCs and adds up their counts
    shards = max(1, -(-every // (4 * shard_tokens)))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, n = _words(row["word"]), _ints(row["n"], np.int32)
            shard = np.array([zlib.crc32(w) for w in words], np.int64) * shards >> 32
            cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            for some in _some(zip(cuts, [*cuts[1:], len(words)], strict=True), 256):
                asked = [(int(shard[lo]), row["batch"], zstandard.compress(b"\n".join(words[lo:hi]), 1), _bytes(n[lo:hi])) for lo, hi in some]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*asked, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "batch", "word", "n"])

    def answer_words(shard: tuple, asked: pa.Table) -> pa.Table:
        lists, count = [_words(w.as_py()) for w in asked.column("word")], {}
        for words, n in zip(lists, asked.column("n"), strict=True):
            for w, k in zip(words, _ints(n.as_py(), np.int32).tolist(), strict=True):
                count[w] = count.get(w, 0) + k
        # numbers of all shards interleave, frequent words having small ones; 0 is START
        number = {w: k * shards + shard[0].as_py() + 1 for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
        if number and max(number.values()) >= WORDS:
            raise ValueError(f"more than {WORDS} distinct words")
        out = [(b.as_py(), shard[0].as_py(), _bytes(np.array([number[w] for w in words], np.int64)), _bytes(np.array([count[w] for w in words], np.int64)), None, None, None) for b, words in zip(asked.column("batch"), lists, strict=True)]
        out.append((None, shard[0].as_py(), None, None, sum(count.values()), sum(k > 0 for k in count.values()), count.get(END)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["of", "shard", "g", "cnt", "tokens", "known", "texts"])

    questions = tokens.select("batch", "word", "n").mapInArrow(ask_words, "shard long, batch long, word binary, n binary")
    numbered = stage(questions.groupBy("shard").applyInArrow(answer_words, "of long, shard long, g binary, cnt binary, tokens long, known long, texts long"), "words")
    sums = numbered.filter("of IS NULL").agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("texts").alias("texts")).first()
    corpus = Corpus(sums.tokens, sums.known, sums.texts or 0, max(1, -(-every // shard_tokens)), shard_tokens)

    coded_schema = f"batch long, key array<bigint>, id array<{kind}>, held_out array<boolean>, size array<int>, lead array<int>, word binary, cnt binary, stream binary, known array<int>, base array<double>"

    def code(_: tuple, batch: pa.Table, found: pa.Table) -> pa.Table:
        """The batch with its words' numbers and counts (START first), and what its pieces score by the counts."""
        order = _ints(batch.column("order")[0].as_py(), np.int32)
        by = np.argsort(found.column("shard").to_numpy())
        number, count = np.zeros(len(order) + 1, np.int64), np.full(len(order) + 1, -1, np.int64)
        for name, out in (("g", number), ("cnt", count)):
            answers = found.column(name).to_pylist()
            out[order] = np.concatenate([_ints(answers[k], np.int64) for k in by])
        each, size = count[_ints(batch.column("stream")[0].as_py(), np.int32)], np.array(batch.column("size")[0].as_py(), np.int64)
        at = np.cumsum(size) - size
        out = {"word": pa.array([_bytes(number)], pa.binary()), "cnt": pa.array([_bytes(count)], pa.binary())}
        out |= {"known": pa.array([np.add.reduceat((each > 0).astype(np.int32), at).tolist()], pa.list_(pa.int32())), "base": pa.array([np.add.reduceat(np.log10(corpus.unigram(each)), at).tolist()], pa.list_(pa.float64()))}
        names = ("batch", "key", "id", "held_out", "size", "lead", "word", "cnt", "stream", "known", "base")
        return pa.table({c: out[c] if c in out else batch.column(c) for c in names})

    found = numbered.filter("of IS NOT NULL").select("of", "shard", "g", "cnt")
    coded = stage(tokens.drop("word", "n").groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(code, coded_schema), "coded")
    for t in (tokens, numbered):
        discard(t)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q = Questions(row, corpus, counted=True)
            for some in _some(q.each(), 256):
                yield pa.record_batch([pa.array([s for s, _, _ in some], pa.int64()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([q.asked(p, r) for _, p, r in some], pa.binary())], names=["shard", "batch", "asked"])
            del q, some  # before the next batch is begun

    asked = coded.select("batch", "held_out", "size", "lead", "word", "cnt", "stream").mapInArrow(ask, "shard long, batch long, asked binary")
    answered = stage(asked.groupBy("shard").applyInArrow(_answer, "batch long, shard long, codes binary, context array<bigint>, total array<bigint>, kinds array<bigint>"), "answers")
    split = answered.filter("batch IS NULL").select(F.explode(F.arrays_zip("context", "total", "kinds")).alias("x")).groupBy("x.context").agg(F.sum("x.total").alias("total"), F.sum("x.kinds").alias("kinds"))
    totals = split.orderBy("context").collect()
    shared = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in totals], np.int64) for k in range(3)))

    def finish(_: tuple, batch: pa.Table, answers: pa.Table) -> pa.Table:
        row = batch.to_pylist()[0]
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("codes").to_pylist(), strict=True))
        logs = _scored(row, got, corpus, shared.value)
        flat = {"key": row["key"], "n_tokens": row["size"], "n_known": row["known"], "base_score": row["base"], "score": logs.tolist()}
        return pa.table({"key": pa.array(flat["key"], pa.int64()), "doc_id": batch.column("id").combine_chunks().flatten(), "held_out": pa.array(row["held_out"], pa.bool_()), **{c: pa.array(flat[c], pa.int64() if c[0] == "n" else pa.float64()) for c in list(flat)[1:]}})

    right = answered.filter("batch IS NOT NULL").select(F.col("batch").alias("of"), "shard", "codes")
    pieces = coded.groupBy("batch").cogroup(right.groupBy("of")).applyInArrow(finish, f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = pieces.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as a row is large."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _words(joined: bytes) -> list[bytes]:
    return zstandard.decompress(joined).split(b"\n")


def _some(items, size: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
