"""Quality rules (operator 3): word, symbol and repetition counts, and tokeniser fertility by public vocabularies.

Every different word of a chunk is tokenised once, by a byte-level vocabulary (characters per token, entropy
of the document's tokens) and by one with byte fallback (share of byte pieces). Rejection bands are fixed
parameters for each script, set around what clean running text measures with these vocabularies: they don't
depend on the corpus or its size.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import coded, ragged, slices, split_words, sums_by_row, table, text_buffers, tidy

CHUNK_BYTES = 1 << 20
#: Words of which a worker remembers the tokens, in each of two generations.
REMEMBERED = 50_000
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Tokens from which the bands hold.
LEAST_TOKENS = 50
SYMBOLS = b"#*$%&|<>"
SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul", "other")
#: script: least and most characters per token, most byte-fallback share, least and most entropy of the tokens in bits.
#: Latin: clean documents of four languages and windows of 50 words of seven measure 1.81 to 5.12 characters, 0.0 and 4.7
#: to 8.7 bits, words with symbols stuck on 1.51 to 1.79 characters. The others: a passage or two of prose each (greek
#: 1.68 to 1.75, cyrillic 2.6 to 2.7, semitic 1.46 to 1.50, cjk 0.79 to 1.02, hangul 1.25 characters), with a quarter of
#: room or more below and twice the most above. Indic and other hold scripts that the vocabularies don't know, too, which
#: are all bytes (about 0.35 characters), so their share isn't limited.
BANDS = {
    "latin": (1.78, 6.5, 0.10, 3.8, 11.0),
    "greek": (1.25, 3.5, 0.10, 4.5, 11.0),
    "cyrillic": (1.9, 5.4, 0.10, 4.5, 11.0),
    "semitic": (1.1, 3.0, 0.10, 4.5, 11.0),
    "indic": (0.25, 2.4, 1.0, 2.4, 11.0),
    "cjk": (0.55, 2.0, 0.50, 4.5, 12.0),
    "hangul": (0.9, 2.5, 0.50, 4.5, 11.0),
    "other": (0.25, 6.5, 1.0, 2.4, 11.0),
}


def _script_table() -> np.ndarray:
    """The script that the first byte of a letter tells, or -1."""
    out = np.full(256, -1, np.int8)
    out[65:91] = out[97:123] = 0
    for first, last, script in ((0xC3, 0xCA, 0), (0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD6, 0xDD, 3), (0xE0, 0xE0, 4), (0xE1, 0xE2, 7), (0xE3, 0xE9, 5), (0xEA, 0xED, 6), (0xEE, 0xF7, 7)):
        out[first : last + 1] = script
    return out


class Fertility:
    """Tokens of single words by two public vocabularies, with a bounded memory."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        from .bpe import ranks_of

        self.bytewise = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of.__wrapped__(ranks_path), special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.new: dict[bytes, tuple[bytes, int, int]] = {}
        self.old: dict[bytes, tuple[bytes, int, int]] = {}

    def words(self, words: list[bytes]) -> list[tuple[bytes, int, int]]:
        """For each word: ids of the byte-level vocabulary (as bytes), pieces, and byte pieces among them."""
        out = [self.new.get(w) or self.old.get(w) for w in words]
        at = [i for i, x in enumerate(out) if x is None]
        texts = [words[i].decode("utf-8", "replace") for i in at]
        pieces = self.pieces.encode(texts, num_threads=1) if texts else []
        sizes = list(map(len, pieces))
        fallback = sums_by_row(self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, sum(sizes))].astype(np.int64), np.array(sizes, np.int64))
        for i, text, size, n in zip(at, texts, sizes, fallback.tolist(), strict=True):
            out[i] = (array("I", self.bytewise.encode_ordinary(" " + text)).tobytes(), size, n)
        self.new.update(zip(words, out, strict=True))
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return out


def repeated_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more among `codes`, the first occurrence included."""
    if len(codes) < 4:
        return 0
    k = codes.astype(np.int64)
    n = int(k.max()) + 1
    keys = (k[:-2] * n + k[1:-1]) * n + k[2:] if n < 1 << 21 else np.unique(np.stack([k[:-2], k[1:-1], k[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    hit = np.zeros(len(k), bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
])
_DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars_per_token double, byte_share double, token_entropy double, script string, base_failed boolean, kept boolean"


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    order = np.sort(ids)
    cuts = np.flatnonzero(order[1:] != order[:-1])
    n = np.diff(np.concatenate([[-1], cuts, [len(order) - 1]]))
    p = n / len(order)
    return float(-(p * np.log2(p)).sum())


def measure(part: pa.RecordBatch, model: Fertility) -> pa.RecordBatch:
    """The rules' counts and verdicts for a batch with doc_id and text."""
    texts = part.column("text")
    words, counts, starts = split_words(texts)
    codes, distinct = coded(words)
    data, offsets = text_buffers(texts)
    rows = np.diff(offsets)
    letters = np.concatenate([[0], np.cumsum((np.frombuffer(words.buffers()[2], np.uint8) & 0xC0) != 0x80 if len(words) else np.zeros(0, bool))])
    word_ends = np.frombuffer(words.buffers()[1], np.int64) if len(words) else np.zeros(1, np.int64)
    ends = np.cumsum(counts)
    first = ends - counts
    word_chars = letters[word_ends[ends]] - letters[word_ends[first]]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = sums_by_row(symbol[data].astype(np.int64), rows)
    kinds = _script_table()[data]
    by_script = np.stack([sums_by_row((kinds == i).astype(np.int64), rows) for i in range(len(SCRIPTS))], 1)
    script = np.where(by_script.sum(1) > 0, by_script.argmax(1), len(SCRIPTS) - 1)
    known = model.words(distinct.to_pylist())
    flat = np.frombuffer(b"".join(x[0] for x in known), np.uint32)
    size = np.fromiter((len(x[0]) // 4 for x in known), np.int64, len(known))
    pieces = np.fromiter((x[1] for x in known), np.int64, len(known))
    fallback = np.fromiter((x[2] for x in known), np.int64, len(known))
    start = np.cumsum(size) - size
    n_tokens = sums_by_row(size[codes], counts)
    n_pieces, n_bytes = sums_by_row(pieces[codes], counts), sums_by_row(fallback[codes], counts)
    out = []
    for i, text in enumerate(texts.to_pylist()):
        own = codes[first[i] : ends[i]]
        n, repeats = len(own), repeated_words(own)
        per, share = (word_chars[i] / n_tokens[i] if n_tokens[i] else 0.0), (n_bytes[i] / n_pieces[i] if n_pieces[i] else 0.0)
        bits, name = entropy(flat[ragged(start[own], size[own])]), SCRIPTS[script[i]]
        low, high, most, least_bits, most_bits = BANDS[name]
        failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
        inside = n_tokens[i] < LEAST_TOKENS or low <= per <= high and share <= most and least_bits <= bits <= most_bits
        out.append((n, int(word_chars[i]), int(n_symbols[i]), duplicate_lines(text or ""), repeats, float(per), float(share), bits, name, failed, bool(not failed and inside)))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in range(11)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(list(c), f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True)]], schema=_OUT)


def quality_rules(docs: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """A row of counts, measures and verdicts for every row of `docs`.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty result.
    """

    @tidy
    def run(batches):
        model = Fertility(ranks_path, pieces_path)  # as long as the task: workers wait for others with what they hold
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                yield measure(part, model)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, _DDL)


def keep_good(docs: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns; null texts go, repeated rows are judged alike."""
    names = docs.columns

    @tidy
    def run(batches):
        model = Fertility(ranks_path, pieces_path)  # as long as the task: workers wait for others with what they hold
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                judged = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column("text")], names=["doc_id", "text"])
                yield part.filter(measure(judged, model).column("kept"))

    return docs.select(*names).mapInArrow(run, docs.schema)


def _paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), *_paths())
