"""Texts that were cut off before their end."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from mishaplens.operators.skew import heavy_keys, split_join
from mishaplens.session import stage

#: Words at both ends of a text in which what was put before or after it is looked for.
ENDS = 16
#: Texts that must have such an affix, and one text in so many.
AFFIX_TEXTS, AFFIX_PART = 8, 20_000
#: Share of the texts with a footer that ends in a stop in which a sentence ends before it, at least.
AFTER_CLOSED = 0.8
#: A length is a spike if its number of texts is less likely than exp(-SPIKE_TEST) by the lengths SPIKE_AROUND it; cuts at a word fall up to SHOULDER short of it.
SPIKE_TEST, SPIKE_AROUND, SHOULDER = 14.0, 25, 15
#: Least number of texts expected at a length, so that empty surroundings prove nothing.
LEAST_USUAL = 0.02
#: Limits of the share of sentence ends below which an ending without a stop counts as cut.
LEAST_ENDS, MOST_ENDS = 0.002, 0.5
#: Texts of up to so many words without a stop are notes or placeholders, not sentences.
NOTE_WORDS = 2
#: Bits of the filter of contexts, as a power of two; it has this size at every scale.
FILTER_BITS = 26
#: A table of spikes of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: Characters of text one task counts contexts of at a time.
SLICE = 8_000_000

_BREAK, _END = "\x02", "\x01"
# Signs that are no part of a word; those that may follow a stop; the stop word of teletypes.
_PUNCTUATION = ".,;:!?()[]{}<>\"'’‘“”„«»…-–—/\\*_|�"
_CLOSERS = "[\"')\\]»”’]*"
_TELETYPE_STOP = "STOP"
_STOP = re.compile(rf"(?<!\.)[.!?]{_CLOSERS}\Z")
_HANGING = re.compile(r"[…�,;:(\[]\Z")
_TOKEN = re.compile(r"[\r\n]\s*|\S+")
#: Marks of a cut at the end of a text; they are no part of its length.
_MARKS = re.compile(r"(?:\s|…|�|\.\.+)+\Z")


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) with a sign for line breaks and digits as one 9."""
    return [(_BREAK if m[0][0] in "\r\n" else re.sub("[0-9]+", "9", m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _strip_breaks(tokens: list) -> list:
    while tokens and tokens[-1][0] == _BREAK:
        tokens = tokens[:-1]
    return tokens


def _without_breaks(words: list[str]) -> list[str]:
    while words and words[-1] == _BREAK:
        words = words[:-1]
    return words


def _normal(column):
    """Texts with a sign for line breaks and digits as one 9, in Arrow."""
    import pyarrow.compute as pc

    t = pc.replace_substring_regex(pc.fill_null(column, ""), r"[\r\n]\s*", f" {_BREAK} ")
    return pc.replace_substring_regex(t, "[0-9]+", "9")


def _slices(column):
    """Parts of an Arrow column of texts with about SLICE characters each."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE)))
        yield column.slice(lo, hi - lo)
        lo = hi


# -------------------------------------------------- what stands before and after


def _both_ends(batches):
    """The first and last words of each text, its lengths and a digest."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        out = [[] for _ in range(7)]
        for item, text in enumerate(b.column(2).to_pylist()):
            if not text or not text.strip():
                continue
            first, last = text.split(None, ENDS), text.rsplit(None, ENDS)
            head = text[: len(text) - len(first[-1])] if len(first) > ENDS else text
            tail = text[len(last[0]) :] if len(last) > ENDS else text
            raw = text.encode()
            n = len(text.split(None, 4 * ENDS))
            for o, v in zip(out, (item, len(text), len(raw), n, head, tail, xxhash.xxh64_intdigest(raw) - (1 << 63))):
                o.append(v)
        at = pa.array(out[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), *[pa.array(o, t) for o, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()))]],
            names=["item_id", "source", "n_chars", "n_bytes", "n_tokens", "head", "tail", "digest"],
        )


def _grams(known: set | None):
    """How many texts begin ('head') or end ('tail') with each sequence of words, and in how many of them a sentence ends before it: up to three words, or with ``known`` sequences of three the longer ones that extend them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n: Counter = Counter()
            closed: Counter = Counter()
            for text in _normal(b.column(0)).to_pylist():
                t = text.split()[:ENDS]
                n.update(("head", " ".join(t[:k])) for k in _sizes(known, "head", t[:3], len(t)))
            for text in _normal(b.column(1)).to_pylist():
                t = _without_breaks(text.split())[-ENDS:]
                for k in _sizes(known, "tail", t[-3:], len(t)):
                    gram = ("tail", " ".join(t[-k:]))
                    n[gram] += 1
                    closed[gram] += _closes(t[-k - 1])
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in n]), pa.array([g for _, g in n]), pa.array(list(n.values()), pa.int64()), pa.array([closed[g] for g in n], pa.int64())], names=["side", "gram", "n", "closed"])

    return run


def _closes(word: str) -> bool:
    return word in (_BREAK, _TELETYPE_STOP) or bool(_STOP.search(word))


def _sizes(known, side, three, n):
    if known is None:
        return range(1, min(3, n - 1) + 1)
    return range(4, n) if (side, " ".join(three)) in known else ()


def _occurrences(patterns: list[str]):
    """Occurrences of sequences of words in whole texts, also where the last word goes on."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa
        import pyarrow.compute as pc

        auto = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            auto.add_word(f" {p}", i)
        auto.make_automaton()
        n = np.zeros(len(patterns), "int64")
        for b in batches:
            for part in _slices(b.column(0)):
                words = pc.binary_join(pc.utf8_split_whitespace(_normal(part)), " ")
                at = [i for text in words.to_pylist() for _, i in auto.iter(f" {text} ")]
                n += np.bincount(np.array(at, "int64"), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array(n)], names=["gram", "n_all"])

    return run


def learned_affixes(texts: DataFrame, ends: DataFrame) -> tuple[list[str], list[str]]:
    """What is put before and after many texts, whatever they say: (headers, footers), of any length up to ENDS words.

    Sequences of words that begin or end AFFIX_TEXTS texts or more (and one in
    AFFIX_PART), stand nearly nowhere else (nor begin other words there, as
    the pieces of words that cuts leave do), have many different neighbours,
    and, at the end, do not close a sentence. ``texts`` has (text), ``ends``
    (head, tail). Numbers count as equal. What comes to the driver is bounded by AFFIX_PART.
    """
    n_texts = ends.count()
    least = max(AFFIX_TEXTS, n_texts // AFFIX_PART)

    def counts(known):
        c = ends.select("head", "tail").mapInArrow(_grams(known), "side string, gram string, n bigint, closed bigint")
        c = c.groupBy("side", "gram").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed")).filter(F.col("n") >= max(2, least // 4))
        return {(r.side, r.gram): (r.n, r.closed) for r in c.collect()}

    both = counts(None)
    both |= counts({(s, g) for (s, g), (n, _) in both.items() if n >= least and g.count(" ") == 2})
    n_of = {g: n for g, (n, _) in both.items()}
    wider: Counter = Counter()
    for (side, gram), n in n_of.items():
        cut = (gram.split(" ", 1) if side == "tail" else gram.rsplit(" ", 1)[::-1]) if " " in gram else None
        if cut and not (side == "tail" and cut[0] != _BREAK and _closes(cut[0])):
            wider[side, cut[1]] = max(wider[side, cut[1]], n)
    names = []
    for (side, gram), n in n_of.items():
        words = gram.split(" ")
        if n < least or wider[side, gram] >= 0.5 * n or gram == _BREAK:
            continue
        if side == "tail":
            three = " ".join(words[-3:])
            if n_of.get((side, gram[:-1]), 0) * 5 > n or n_of.get((side, three[:-1]), 0) * 5 > n_of[side, three] or any(_closes(w) for w in words[:-1] if w not in (_BREAK, _TELETYPE_STOP)):
                continue  # a sentence ends like this, with or without its stop, or ends inside
            if not any(c.isalnum() for c in gram) or _TELETYPE_STOP in words[1:]:
                continue
            if (_STOP.search(gram) or gram.endswith(("..", "…"))) and (len(words) == 1 or both[side, gram][1] < AFTER_CLOSED * n):
                continue
        names.append((side, gram))
    if not names:
        return [], []

    def occurrences(of: DataFrame) -> dict[str, int]:
        found = of.mapInArrow(_occurrences(sorted({g for _, g in names})), "gram string, n_all bigint")
        return {r.gram: r.n_all for r in found.groupBy("gram").agg(F.sum("n_all").alias("n_all")).collect()}

    # what stands too often in the first and last words alone need not be looked for in whole texts
    least_of = occurrences(ends.filter(F.col("n_tokens") > 2 * ENDS).select(F.explode(F.array("head", "tail")).alias("text")))
    names = [(s, g) for s, g in names if n_of[s, g] >= 0.9 * least_of.get(g, 0)]
    if not names:
        return [], []
    total = occurrences(texts.select("text"))
    found = sorted(((s, g.strip(f"{_BREAK} ")) for s, g in names if n_of[s, g] >= 0.9 * total[g]), key=lambda x: (x[1].count(" "), x))
    kept: dict[str, list[str]] = {"head": [], "tail": []}
    for side, g in found:  # the shortest of those that are alike
        if not any(g == s or (g.endswith(" " + s) if side == "tail" else g.startswith(s + " ")) for s in kept[side]):
            kept[side].append(g)
    return kept["head"], kept["tail"]


def _bare_ending(head: str, tail: str, n_tokens: int, headers: dict, footers: dict):
    """(core tokens, texts before and after the core, whether a footer was taken off, words left)."""
    tokens = _strip_breaks(_tokens(tail))
    removed = 0
    for _ in range(2):
        for k in sorted(footers):
            if len(tokens) >= k and " ".join(t for t, _, _ in tokens[-k:]) in footers[k]:
                k -= _closes(tokens[-k][0]) and tokens[-k][0] != _BREAK  # the stop before it belongs to the text
                tokens, removed = _strip_breaks(tokens[:-k]), removed + k
                break
    after = tail[tokens[-1][2] :] if tokens else tail
    mark = _MARKS.search(tail[: len(tail) - len(after)])
    first = _tokens(head)
    start = 0
    for k in sorted(headers):
        if len(first) > k and " ".join(t for t, _, _ in first[:k]) in headers[k]:
            start = first[k][1]
            removed += k
            break
    before = head[:start] if start else head[: len(head) - len(head.lstrip())]
    return tokens, before, (mark[0] if mark else "") + after, removed > 0, n_tokens - removed


def _by_words(grams: list[str]) -> dict[int, set]:
    out: dict[int, set] = {}
    for g in grams:
        out.setdefault(g.count(" ") + 1, set()).add(g)
    return out


# ----------------------------------------------------------- contexts of words


def _word_codes(texts):
    """(hash of each word, text it is in, letters of each word) of an Arrow array of texts; ends of sentences and of lines are words of their own (_sign)."""
    import pyarrow.compute as pc
    import xxhash

    t = pc.replace_substring_regex(texts, r"\.\.+", "…")
    t = pc.replace_substring_regex(t, rf"[.!?]{_CLOSERS}(?:[\s\p{{Z}}]|$)", f" {_END} ")
    t = pc.replace_substring_regex(t, rf"(^|\s){_TELETYPE_STOP}(\s|$)", f" {_END} ")
    t = pc.utf8_lower(pc.replace_substring_regex(t, rf"[\r\n{_BREAK}]+", f" {_BREAK} "))
    t = pc.replace_substring_regex(pc.replace_substring_regex(t, "[0-9]+", "9"), "[" + re.escape(_PUNCTUATION) + "]", "")
    lists = pc.utf8_split_whitespace(t)
    words = lists.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    vocabulary = words.dictionary.to_pylist()
    codes = words.indices.to_numpy(zero_copy_only=False)
    real = np.array([w != "" for w in vocabulary], bool)[codes] if len(codes) else np.zeros(0, bool)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], "uint64")
    letters = np.array([len(w) for w in vocabulary], "int64")
    codes, of = codes[real], of[real]
    return (hashes[codes], of, letters[codes]) if len(codes) else (np.zeros(0, "uint64"), of, np.zeros(0, "int64"))


def _sign(sign: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(sign))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    with np.errstate(over="ignore"):
        x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _contexts(h: np.ndarray, of: np.ndarray):
    """For each word the hash of it with the word before, the word before both, as far as the sentence goes; and whether a sentence ends after it.

    That is -1, unknown, where the text ends, and before a line break among
    its last ENDS words, as one may stand between a cut and a footer.
    """
    end, line = _sign(_END), _sign(_BREAK)
    if not len(h):
        return h, h, np.zeros(0, "int8")
    lines = np.flatnonzero(h == line)
    h = h.copy()
    h[lines] = end
    ended = h == end
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    last = np.r_[first[1:], len(of)] - 1
    v = np.r_[end, h[:-1]]
    v[first] = end
    u = np.r_[end, v[:-1]]
    u[v == end] = end
    ends = np.empty(len(h), "int8")
    ends[:-1] = ended[1:]
    ends[last] = -1
    near = lines[last[np.searchsorted(last, lines)] - lines < ENDS]
    ends[near[near > 0] - 1] = -1
    ends[ended] = -1
    return _mixed(v, h), u, ends


def _context_counts(bits: np.ndarray):
    """How often each context that passes the filter occurs, and how often a sentence ends after it; one row without a context has the letters and sentences of all."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in _slices(b.column(0)):
                h, of, letters = _word_codes(part)
                two, before, ends = _contexts(h, of)
                seen = ends >= 0
                total = (int(letters[seen].sum() + seen.sum()), int((ends > 0).sum()))
                at = two & np.uint64((1 << FILTER_BITS) - 1)
                kept = np.flatnonzero(seen & (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))
                two = two[kept]
                key, first, inverse = np.unique(_mixed(before[kept], two), return_index=True, return_inverse=True)
                n = np.bincount(inverse, minlength=len(key)).astype("int64")
                e = np.bincount(inverse, ends[kept], minlength=len(key)).astype("int64")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view("int64")), pa.array(two[first].view("int64")), pa.array(n), pa.array(e)],
                    names=["three", "two", "n", "e"],
                )
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())], names=["three", "two", "n", "e"])

    return run


def _endings(headers: list[str], footers: list[str]):
    """What is judged of each text: its lengths without what was put around it, how it ends, and the context of its last word. Texts that close need no more than that."""
    heads, foots = _by_words(headers), _by_words(footers)
    last_of_footer = {g.rsplit(" ", 1)[-1] for g in footers}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = {k: [] for k in ("chars", "bytes", "body_chars", "body_bytes", "bare", "is_text", "hanging", "stop")}
            last_words, open_rows = [], []
            for n_chars, n_bytes, n_tokens, head, tail in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 5, 6)]):
                last = tail.rsplit(None, 1)[-1]
                if _closes(last) and re.sub("[0-9]+", "9", last) not in last_of_footer:
                    facts = (n_chars, n_bytes, n_chars, n_bytes, True, True, False, True)
                else:
                    tokens, before, after, affixed, left = _bare_ending(head, tail, n_tokens, heads, foots)
                    last = tail[tokens[-1][1] : tokens[-1][2]] if tokens else ""
                    stop = bool(_STOP.search(last)) or last == _TELETYPE_STOP
                    lone = bool(last) and not stop and not any(c.isalnum() for c in last)
                    blank = len(head) - len(head.lstrip())
                    chars, size = n_chars - len(after), n_bytes - len(after.encode())
                    facts = (chars - blank, size - blank, chars - len(before), size - len(before.encode()), not affixed, left > NOTE_WORDS or stop, lone or bool(_HANGING.search(last)), stop)
                    if not stop:
                        open_rows.append(len(rows["stop"]))
                        last_words.append(" ".join("\n" if t == _BREAK else tail[s:e] for t, s, e in tokens[-8:]))
                for k, x in zip(rows, facts):
                    rows[k].append(x)
            h, of, _ = _word_codes(pa.array(last_words, pa.string()))
            two, before_two, _ = _contexts(h, of)
            three = _mixed(before_two, two)
            at = np.searchsorted(of, np.arange(len(open_rows)), "right") - 1  # the last word of each
            out = np.zeros((2, b.num_rows), "int64")
            if len(of):
                ok = (at >= 0) & (of[np.maximum(at, 0)] == np.arange(len(open_rows)))
                for o, a in zip(out, (two, three)):
                    o[np.array(open_rows, "int64")[ok]] = a[at[ok]].view("int64")
            numbers = [pa.array(rows[k], pa.int64()) for k in ("chars", "bytes", "body_chars", "body_bytes")]
            flags = [pa.array(rows[k], pa.bool_()) for k in ("bare", "is_text", "hanging", "stop")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(7), *numbers, *flags, pa.array(out[0]), pa.array(out[1])],
                names=["item_id", "source", "digest", "chars", "bytes", "body_chars", "body_bytes", "bare", "is_text", "hanging", "stop", "two", "three"],
            )

    return run


def _ending_shares(texts: DataFrame, open_ends: DataFrame) -> tuple[DataFrame, float]:
    """(three, ends): for each context of an open ending the share of its places in all texts at which a sentence ends; and the letters per sentence.

    A filter of fixed size keeps contexts that no open ending has from being
    shuffled; those that pass it by chance are dropped by the join.
    """
    wanted = open_ends.groupBy("two", "three").agg(F.count("*").alias("n_texts"))
    bit = F.col("two").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    marks = wanted.groupBy(F.shiftrightunsigned(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(two & {63} as int))")).alias("bits")).toPandas()  # 2^(FILTER_BITS - 6) rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), "uint64")
    bits[marks["w"].to_numpy("int64")] = marks["bits"].to_numpy("int64").view("uint64")
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        yield from _context_counts(shared.value)(batches)

    seen = texts.select("text").mapInArrow(count, "three bigint, two bigint, n bigint, e bigint")
    seen = stage(seen.groupBy("three", "two").agg(F.sum("n").alias("n"), F.sum("e").alias("e")), "contexts")
    n_chars, n_ends = seen.filter("three is null").agg(F.sum("n"), F.sum("e")).first()
    by_two = seen.filter("two is not null").groupBy("two").agg(F.sum("n").alias("n2"), F.sum("e").alias("e2"))
    # a last word never met after the one before it is taken for a part of a word
    share = F.when(F.col("n3") >= 1, F.col("e3") / F.col("n3")).when(F.col("n2") >= 1, F.col("e2") / F.col("n2")).otherwise(0.0)
    known = wanted.join(seen.select("three", F.col("n").alias("n3"), F.col("e").alias("e3")), "three", "left").join(by_two, "two", "left")
    return stage(known.select("three", share.alias("ends"), "n_texts"), "ending_shares"), max(1.0, (n_chars or 0) / max(1, n_ends or 0))


# -------------------------------------------------------------------- lengths


def length_spikes(open_texts: DataFrame) -> DataFrame:
    """Lengths at which a field ends: s, measure, length, excess (texts above the usual, over the usual), shoulder (the same for the lengths just below, null if usual).

    ``open_texts`` has (s, digest, chars, bytes, body_chars, body_bytes). Per
    source, and for characters and bytes with and without a header, the
    histogram of lengths is tested: a length is the maximum of a field if its
    number of different texts is too large to come by chance (a Poisson bound
    by the lengths around it) and no more texts lie just above it than just below. Where a
    field cuts at a word, the lengths just below are tested in the same way.
    """
    kinds = ("chars", "bytes", "body_chars", "body_bytes")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("length")) for k in kinds])).alias("m")
    counts = open_texts.select("s", "digest", *kinds).distinct().select("s", each).groupBy("s", "m.measure", "m.length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("s", "measure").orderBy("length")  # one row per length, and lengths have an end
    within = lambda a, b: F.coalesce(F.sum("n").over(w.rangeBetween(a, b)), F.lit(0))
    usual = F.greatest(F.lit(LEAST_USUAL), (F.col("above") + F.col("far")) / (2 * SPIKE_AROUND))
    surprise = lambda n, mu: F.when(n > mu, n * F.log(n / mu) - n + mu).otherwise(0.0)
    near, n = F.col("near"), F.col("n")
    return (
        counts.withColumn("above", within(1, SPIKE_AROUND))
        .withColumn("below", within(-SPIKE_AROUND, -1))
        .withColumn("far", within(-SHOULDER - SPIKE_AROUND, -SHOULDER - 1))
        .withColumn("near", within(-SHOULDER, -1))
        .withColumn("usual", usual)
        .filter((surprise(n, F.col("usual")) >= SPIKE_TEST) & (F.col("above") <= F.col("below") + F.col("n")))
        .withColumn("shoulder", F.when(surprise(near, SHOULDER * F.col("usual")) >= SPIKE_TEST, near / (SHOULDER * F.col("usual")) - 1))
        .select("s", "measure", "length", (n / F.col("usual") - 1).alias("excess"), "shoulder")
    )


def _at_spikes(open_texts: DataFrame, spikes: DataFrame) -> DataFrame:
    """``open_texts`` with ``excess`` (null unless at a spike in any measure) and ``shoulder`` (null unless just below one)."""
    below = spikes.filter("shoulder is not null").select("s", "measure", F.explode(F.sequence(F.col("length") - SHOULDER, F.col("length") - 1)).alias("length"), "shoulder")
    every = spikes.select("s", "measure", "length", "excess", F.lit(None).cast("double").alias("shoulder")).unionByName(below, allowMissingColumns=True)
    table = stage(every.groupBy("s", "measure", "length").agg(F.max("excess").alias("excess"), F.max("shoulder").alias("shoulder")), "spikes")
    few = table.count() <= BROADCAST_ROWS
    out = open_texts
    kinds = ("chars", "bytes", "body_chars", "body_bytes")
    for k in kinds:
        side = table.filter(F.col("measure") == k).select("s", F.col("length").alias(k), F.col("excess").alias(f"x_{k}"), F.col("shoulder").alias(f"y_{k}"))
        if few:
            out = out.join(F.broadcast(side), ["s", k], "left")
        else:  # spikes are hot keys by their nature
            out = split_join(out, side, ["s", k], heavy_keys(out.groupBy("s", k).agg(F.count("*").alias("n")), ["s", k]), "left")
    xs, ys = [F.col(f"x_{k}") for k in kinds], [F.col(f"y_{k}") for k in kinds]
    return out.withColumn("excess", F.greatest(*xs)).withColumn("shoulder", F.greatest(*ys)).drop(*[f"{p}_{k}" for p in "xy" for k in kinds])


def judged_texts(texts: DataFrame) -> DataFrame:
    """One row per text: item_id, source, is_text, at_spike, ends, limit, found_by, truncated.

    ``texts`` has (item_id, source, text); other columns are ignored. Null and
    blank texts give no row; placeholders and notes (up to NOTE_WORDS words
    without a stop) are no texts and never truncated. A null source is a
    source of its own. Repeated texts are judged alike but count once in the
    histograms. Whole texts are read.

    Method: what was put before and after many texts is learned and taken off.
    Then lengths decide first: per source, histograms in characters and bytes
    are tested for spikes at the maximum of a field (length_spikes), and a
    text of such a length without a stop is cut (found_by 'length'); only in a
    source that hardly ever sets one, so that its lack says nothing, the
    ending is looked at too. What is cut in transfer has any length, so a second way follows: an ending without
    a stop is held against the corpus, in all of which the places with the
    same last three words (two, where unseen) are counted; ``ends`` is the
    share of them at which a sentence ends. A text is cut if that is below
    ``limit``, which weighs how often the source drops the last stop against
    how often it cuts ('context'); just below a spike, where fields cut at a
    word, the limit is higher ('near_length'). An ellipsis sign, a replacement
    character, a comma or an open bracket at the end is a cut too ('mark').
    """
    base = texts.select("item_id", "source", "text")
    kinds = dict(base.dtypes)
    ids = f"item_id {kinds['item_id']}, source string"
    ends = stage(base.mapInArrow(_both_ends, f"{ids}, n_chars bigint, n_bytes bigint, n_tokens int, head string, tail string, digest bigint"), "ends")
    headers, footers = learned_affixes(base, ends)
    lengths = "chars bigint, bytes bigint, body_chars bigint, body_bytes bigint"
    facts = stage(ends.mapInArrow(_endings(headers, footers), f"{ids}, digest bigint, {lengths}, bare boolean, is_text boolean, hanging boolean, stop boolean, two bigint, three bigint"), "endings")
    facts = facts.withColumn("s", F.coalesce("source", F.lit("")))
    open_ends = facts.filter("is_text and not stop")

    shares, per_end = _ending_shares(base, open_ends)
    scored = split_join(open_ends, shares.groupBy("three").agg(F.first("ends").alias("ends")), ["three"], heavy_keys(shares.select("three", F.col("n_texts").alias("n")), ["three"]))
    scored = stage(_at_spikes(scored, length_spikes(open_ends)), "scored_endings")

    usual = F.col("excess").isNull() & F.col("shoulder").isNull()
    by = ["s", "bare"]
    rates = scored.groupBy(*by).agg(F.count_if(usual & ~F.col("hanging") & (F.col("ends") >= 0.5)).alias("open"), F.count_if(usual & (F.col("hanging") | (F.col("ends") < 0.001))).alias("cut"))
    all_of = facts.filter("is_text").groupBy(*by).agg(F.count("*").alias("n"))
    rates = all_of.join(rates, by, "left").na.fill(0).select(*by, "n", ((F.col("open") + 1) / (F.col("n") + 2)).alias("u_open"), ((F.col("cut") + 1) / (F.col("n") + 2)).alias("u_cut"))
    rates = stage(rates, "source_rates")
    near = F.greatest(F.lit(LEAST_ENDS), F.least(F.lit(MOST_ENDS), F.col("u_cut") / F.col("u_open") / per_end))
    weighed = lambda excess: excess / F.col("u_open") / per_end
    limit = F.when(F.col("excess").isNotNull(), F.greatest(near, weighed(F.col("excess")))).when(F.col("shoulder").isNotNull(), F.greatest(near, F.least(F.lit(MOST_ENDS), weighed(F.col("shoulder"))))).otherwise(near)
    below = F.col("ends") < limit
    way = F.when(F.col("excess").isNotNull() & (below | (limit >= 1)), "length").when(F.col("hanging"), "mark").when(below & F.col("shoulder").isNotNull(), "near_length").when(below, "context")
    judged = split_join(scored, rates, by, heavy_keys(rates.select(*by, "n"), by)).select(
        "item_id", "source", F.lit(True).alias("is_text"), F.col("excess").isNotNull().alias("at_spike"), "ends", limit.alias("limit"), way.alias("found_by")
    )
    closed = facts.filter("not is_text or stop").select(
        "item_id", "source", "is_text", F.lit(False).alias("at_spike"), F.lit(None).cast("double").alias("ends"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("string").alias("found_by")
    )
    return judged.unionByName(closed).withColumn("truncated", F.col("found_by").isNotNull())


def truncation_report(texts: DataFrame) -> DataFrame:
    """Per source: texts, those truncated, how many of them by each way, and the share truncated."""
    return (
        judged_texts(texts)
        .filter("is_text")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_texts"),
            F.count_if("truncated").alias("n_truncated"),
            *[F.count_if(F.col("found_by") == k).alias(f"n_by_{k}") for k in ("length", "near_length", "mark", "context")],
        )
        .withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
    )
