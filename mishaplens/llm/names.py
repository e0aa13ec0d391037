"""Variant spellings of names typed by people, by a noisy channel."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mishaplens.session import stage

#: Items of a reference that every task reads at a time; a larger one is compared block by block.
MAX_REFERENCE = 100_000
#: Forms with learned words that every task reads at a time; what is learned for more is compared piece by piece.
MAX_FORMS = 200_000
#: A spelling that costs at most this is written as an item is, and counts for its prior.
AS_WRITTEN = 0.5
#: Natural logarithm of the likelihood lost per unit of channel cost; and costs above which a spelling means no item.
SHARPNESS, MOST_CORE, MOST_TOTAL = 6.0, 0.37, 0.28
#: Items are compared in whole if their distinctive word fits worse than the best by no more than this share of its letters.
NEAR_BEST = 0.15
#: A distinctive word is looked at if a spelling has this share of its pairs of letters, next to each other or with one between.
BLOCK_SHARE = 0.2
#: Cost of a learned short form of a given name, and of any other word with its first letter.
LEARNED, SAME_INITIAL = 0.2, 0.6
#: Cost of a word beside the exact name of a model.
OTHER_WORD = 0.4
#: A word is learned as an alternative or an addition from so many different spellings.
LEARN_FROM = 2

# Neighbouring keys, row by row.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
# Digits typed for letters.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

def _substitution() -> np.ndarray:
    """Cost of one character for another, by code."""
    cost = np.full((128, 128), 1.2, "f4")
    at = {c: (r, i + 0.4 * r) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    for a, (ra, xa) in at.items():
        for b, (rb, xb) in at.items():
            if a != b and abs(ra - rb) <= 1 and abs(xa - xb) <= 1.1:
                cost[ord(a), ord(b)] = 0.8
    for d, letters in LOOKALIKES.items():
        for c in letters:
            cost[ord(d), ord(c)] = 0.1
    np.fill_diagonal(cost, 0)
    return cost


_SUB = _substitution()


def compact(s: str) -> str:
    """Letters and digits only, lower case, without accents."""
    s = unicodedata.normalize("NFKD", s)
    return re.sub("[^a-z0-9]", "", "".join(c for c in s if not unicodedata.combining(c)).lower())


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], "int64")
    out = np.zeros((len(words), max(1, n.max(initial=1))), "uint8")
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("ascii"), "uint8")
    return out, n


def channel_costs(typed: list[str], forms: list[str], drop: list[np.ndarray] | None = None, inside: bool = False) -> np.ndarray:
    """Cost of typing each of ``typed`` for the form beside it.

    Edits are substitutions (cheap for neighbouring keys and look-alikes),
    swaps, insertions (cheaper if a letter is doubled) and omissions.
    ``drop`` has the cost of omitting each character of a form, which makes
    abbreviations cheap where words are often shortened; other edits there
    cost less as well. ``inside``: the form may stand anywhere in what was
    typed. All pairs advance together, one cell of the table at a time.
    """
    s, ns = _matrix(typed)
    f, nf = _matrix(forms)
    p, width = len(typed), f.shape[1]
    gone = np.ones((p, width), "f4")
    if drop is not None:
        for i, d in enumerate(drop):
            gone[i, : len(d)] = d
    soft = np.where(gone < 0.5, np.float32(0.6), np.float32(1))
    rows = np.arange(p)
    first = np.zeros((width + 1, p), "f4")
    first[1:] = np.cumsum(gone.T, axis=0)
    before, above = None, first
    best = first[nf, rows].copy() if inside else np.where(ns == 0, first[nf, rows], np.inf).astype("f4")
    for i in range(s.shape[1]):
        c = s[:, i]
        now = np.empty_like(first)
        doubled = (s[:, i - 1] == c) if i else np.zeros(p, bool)
        extra = np.where(doubled, np.float32(0.7), np.float32(1))
        now[0] = 0 if inside else above[0] + extra
        for j in range(width):
            g = f[:, j]
            v = above[j] + _SUB[c, g] * soft[:, j]
            np.minimum(v, above[j + 1] + extra * soft[:, j], out=v)
            np.minimum(v, now[j] + gone[:, j], out=v)
            if i and j:
                swap = (c == f[:, j - 1]) & (s[:, i - 1] == g) & (c != g)
                if swap.any():
                    v = np.where(swap, np.minimum(v, before[j - 1] + np.float32(0.9) * soft[:, j]), v)
            now[j + 1] = v
        before, above = above, now
        end = now[nf, rows]
        if inside:
            best = np.where(i < ns, np.minimum(best, end), best)
        else:
            best = np.where(ns == i + 1, end, best)
    return best


def _dropping(parts: list[tuple[str, bool]]) -> tuple[str, np.ndarray]:
    """A form from its parts and the cost of omitting each character: low inside a part that is often shortened."""
    text, cost = "", []
    for w, short in parts:
        text += w
        cost += [0.4] + [0.15] * (len(w) - 1) if short else [1.0] * len(w)
    return text, np.array(cost, "f4")


def _words(s: str) -> list[str]:
    return [c for w in re.split(r"[^\w]+|_", s) if (c := compact(w))]


def _pairs(word: str) -> set[str]:
    return {word[i] + word[j] for i in range(len(word)) for j in (i + 1, i + 2) if j < len(word)}


class Reference:
    """Items with a distinctive word each, the forms they are written in, and codes that stand for them.

    The distinctive word of a label is its first, or its second if the first
    is a given name: the words from the third on also end other labels, or
    the second is in more spellings than the first (``typed``), and no other
    label ends in the words from the second on. ``learned`` has words typed in
    place of a given name.
    """

    #: Ways to find the items a spelling may mean: the first that finds any for it holds.
    PHASES = ("_coded", "_exact", "_channel")
    #: Of these, those in which the item of the smallest id has the spelling, and those that read what is learned.
    FIRST, LEARNING = {"_coded"}, {"_exact", "_channel"}

    def __init__(self, rows: list[tuple], learned: dict[str, set] | None = None, typed: dict[str, int] | None = None, ends: dict[str, int] | None = None) -> None:
        """``rows``: (ref_id, label, short_form, also_known); ``ends``: how often each of ``ends(rows)`` is there in the whole reference, if ``rows`` is a block of one."""
        self.learned, typed = learned or {}, typed or {}
        self.cores, self.core_of, self.given, self.forms, self.codes, self.written = [], [], [], {}, {}, {}
        labels = [(ref, _words(label or ""), code, other) for ref, label, code, other in rows]
        tails = Counter(self.ends(rows)) if ends is None else ends
        for ref, words, code, other in labels:
            if not words:
                continue
            own, rest = " ".join(words[1:]), " ".join(words[2:])
            at = int(len(words) > 2 and tails[own] == 1 and (tails[rest] > 1 or typed.get(words[1], 0) > typed.get(words[0], 0)))
            given, core, tail = words[0] if at else None, words[at], words[at + 1 :]
            self._add(ref, core, given, self._written(core, tail, given))
            if other and compact(other):
                w = _words(other)
                self._add(ref, w[0], None, self._written(w[0], w[1:], None) + [_dropping([(w[0], False), *[(x, True) for x in w[1:]], *[(x, True) for x in t]]) + (0.3,) for t in ([tail[-1:], tail] if tail else [])])
            if code and compact(code):
                c = compact(code)
                self.codes.setdefault(c, (ref, 0.0))
                for k in range(1, len(tail) + 1):
                    self.codes.setdefault(c + "".join(tail[:k]), (ref, 0.1))
        for (ref, _), forms in self.forms.items():
            for w, _, c in forms:
                found = self.written.setdefault(w, {})
                found[ref] = min(c, found.get(ref, np.inf))
        self.named = {c: (g, r) for c, g, r in zip(self.cores, self.given, self.core_of) if g}
        self._index()

    @classmethod
    def ends(cls, rows: list[tuple]) -> list[str]:
        """The words from the second and from the third on of every label."""
        return [" ".join(words[k:]) for _, label, *_ in rows for words in [_words(label or "")] for k in (1, 2) if len(words) > k]

    def _index(self) -> None:
        """Distinctive words by their pairs of letters, and the longest spelling that can come near any form."""
        self.sizes = np.array([len(c) for c in self.cores])
        with_pair: dict[str, list] = {}
        for k, core in enumerate(self.cores):
            for g in _pairs(core):
                with_pair.setdefault(g, []).append(k)
        self.with_pair = {g: np.array(v) for g, v in with_pair.items()}
        self.needed = np.array([BLOCK_SHARE * len(_pairs(c)) for c in self.cores])
        # an extra letter costs 0.42 at least, and more than the allowed cost is no match
        self.longest = max((len(w) + (MOST_TOTAL * len(w) + 1) / 0.42 for v in self.forms.values() for w, _, _ in v), default=0)

    def _written(self, core, tail, given):
        """(form, omission costs, cost of writing it so)."""
        tails = [(tail, 0.0)] + [(tail[:k], 0.3) for k in range(1, len(tail))] + ([([], 0.3)] if tail else [])
        firsts = [(None, 0.0)]
        if given:
            firsts = [(given, 0.0), *[(n, LEARNED) for n in sorted(self.learned.get(given, ()))], (given[0], 0.3), (None, 0.4)]
        out = []
        for t, ct in tails:
            rest = [(w, True) for w in t]
            for g, cg in firsts:
                name = [(core, False)]
                orders = [([(g, False)] + name + rest, 0.0), (name + [(g, False)] + rest, 0.2)] if g else [(name + rest, 0.0)]
                if rest:
                    orders += [(rest + [(g, False)] + name, 0.2)] if g else [(rest + name, 0.2)]
                out += [(*_dropping(o), ct + cg + co) for o, co in orders]
        return out

    def _add(self, ref, core, given, forms):
        self.core_of.append(ref)
        self.cores.append(core)
        self.given.append(given)
        self.forms.setdefault((ref, core), []).extend(forms)

    def evidence(self, words: list[str]):
        """(ref_id, told): a word typed beside a distinctive word in place of the given name of its label, after that name; '' if it is none."""
        if len(words) > 1 and words[1] in self.named:
            given, ref = self.named[words[1]]
            w, label = words[0], self.forms[ref, words[1]][0][0]
            yield ref, f"{given} {w}" if len(w) > 1 and w != given and w not in label else ""

    @staticmethod
    def told(words: list[str], found: list[tuple]) -> str:
        """What a spelling tells by its evidence from all items: "given word", or ''."""
        return max(found)[1] if found else ""

    def added_forms(self) -> Counter:
        """For each given name the most forms that a word learned for it adds."""
        out: Counter = Counter()
        for ref, core, given in zip(self.core_of, self.cores, self.given):
            if given:
                out[given] += len(self.forms[ref, core])
        return out

    def _near(self, s: str) -> np.ndarray:
        """Distinctive words with enough pairs of letters in common with what was typed; digits also as the letters they look like."""
        seen = _pairs(s)
        for k in range(max(map(len, LOOKALIKES.values()))):
            seen |= _pairs(s.translate({ord(d): letters[min(k, len(letters) - 1)] for d, letters in LOOKALIKES.items()}))
        found = [self.with_pair[g] for g in seen if g in self.with_pair]
        hits = np.bincount(np.concatenate(found), minlength=len(self.cores)) if found else np.zeros(len(self.cores))
        return np.flatnonzero(hits >= self.needed)

    def candidates(self, typed: list[list[str]]) -> list[dict]:
        """For each spelling (its words) the items it may mean, each with the cost of its cheapest form."""
        out: list[dict] = [{} for _ in typed]
        for phase in self.PHASES:
            left = [i for i, found in enumerate(out) if not found]
            for i, found in zip(left, getattr(self, phase)([typed[i] for i in left])):
                out[i] = found
        return out

    def _coded(self, typed: list[list[str]]) -> list[dict]:
        return [dict([self.codes[s]]) if (s := "".join(w)) in self.codes else {} for w in typed]

    def _exact(self, typed: list[list[str]]) -> list[dict]:
        return [dict(self.written.get("".join(w), ())) for w in typed]

    def _fits(self, typed: list[list[str]]) -> tuple[list, list, np.ndarray]:
        """Spellings, the distinctive words near them and how well these fit."""
        who, core = [], []
        for i, words in enumerate(typed):
            s = "".join(words)
            if s and len(s) - (len(words[0]) if len(words) > 1 else 0) <= self.longest:  # a first word may stand for its initial
                near = self._near(s)
                who += [i] * len(near)
                core += near.tolist()
        if not who:
            return who, core, np.zeros(0)
        return who, core, np.array(_in_steps(["".join(typed[i]) for i in who], [self.cores[k] for k in core], None, [0.0] * len(who), inside=True)) / self.sizes[core]

    def nearest(self, typed: list[list[str]]) -> np.ndarray:
        """For each spelling how well the best distinctive word fits."""
        return self._least(len(typed), *self._fits(typed)[::2])

    @staticmethod
    def _least(n: int, who: list, fit: np.ndarray) -> np.ndarray:
        best = np.full(n, np.inf)
        np.minimum.at(best, np.array(who, "int64"), fit)
        return best

    def _channel(self, typed: list[list[str]], best: list[float] | None = None) -> list[dict]:
        """``best``: ``nearest`` among all items, if these are a block of them."""
        out: list[dict] = [{} for _ in typed]
        who, core, fit = self._fits(typed)
        if best is None:
            best = self._least(len(typed), who, fit)

        def ways():
            for i, k, f in zip(who, core, fit):
                if f > MOST_CORE or f > best[i] + NEAR_BEST:
                    continue
                whole, ref, given = "".join(typed[i]), self.core_of[k], self.given[k]
                ways = [(whole, 0.0, self.forms[ref, self.cores[k]])]
                if given and len(typed[i]) > 1 and typed[i][0][0] == given[0]:
                    ways.append(("".join(typed[i][1:]), SAME_INITIAL, [f for f in self.forms[ref, self.cores[k]] if given not in f[0]]))
                for s, extra, forms in ways:
                    for w, d, c in forms:
                        if abs(len(s) - len(w)) <= 0.4 * len(w) + 3 or len(s) < len(w):
                            yield (i, ref), s, w, d, c + extra

        for (i, ref), s, w, c in _compared(ways()):
            if c <= MOST_TOTAL * min(len(w), len(s)) + 1:
                out[i][ref] = min(c, out[i].get(ref, np.inf))
        return out


def _compared(ways, at_a_time: int = 500_000):
    """(key, typed, form, cost) of (key, typed, form, omission costs or None, cost of the form), so many in memory at a time."""
    ways = iter(ways)
    while part := list(itertools.islice(ways, at_a_time)):
        key, text, form, drop, base = (list(x) for x in zip(*part))
        yield from zip(key, text, form, _in_steps(text, form, drop if drop[0] is not None else None, base))


def _in_steps(text: list, form: list, drop: list | None, base: list, step: int = 20_000, inside: bool = False) -> list[float]:
    """Costs of many pairs, so many at a time, those of like lengths together; each with the cost of its form added."""
    order = sorted(range(len(text)), key=lambda i: (len(text[i]), len(form[i])))
    out = np.zeros(len(text))
    for a in range(0, len(text), step):
        at = order[a : a + step]
        out[at] = channel_costs([text[i] for i in at], [form[i] for i in at], drop and [drop[i] for i in at], inside)
    return (out + np.array(base)).tolist() if len(text) else []


class ModelReference(Reference):
    """Items of a word and a number: the number must be the same, the word goes through the channel. Items of another shape, and spellings that fit none, go the general way.

    ``learned`` has, under '', words that are added to a model's name.
    """

    PHASES = ("_by_code", "_by_number_code", "_by_number", *Reference.PHASES)
    FIRST, LEARNING = {"_by_code", "_by_number_code", *Reference.FIRST}, {"_by_number"}

    def __init__(self, rows: list[tuple], learned: dict[str, set] | None = None, typed: dict[str, int] | None = None, ends: dict[str, int] | None = None) -> None:
        self.by_number: dict[str, list] = {}
        self.number_codes, general = {}, []
        self.added = sorted((learned or {}).get("", ()))
        for ref, label, code, other in rows:
            shaped = self._shaped(label, other)
            for number, word in shaped:
                self.by_number.setdefault(number, []).append((ref, word))
            if code and compact(code):
                self.number_codes.setdefault(compact(code), (ref, 0.0))
            if not shaped:
                general.append((ref, label, code, other))
        super().__init__(general, learned, typed, ends)

    @staticmethod
    def _shaped(label: str | None, other: str | None) -> list[tuple]:
        """(number, word) of the names that are a word and a number."""
        return [(m[2].lstrip("0"), m[1]) for name in (label, other) if (m := re.fullmatch(r"([a-z]+)([0-9]+)", compact(name or "")))]

    @classmethod
    def ends(cls, rows: list[tuple]) -> list[str]:
        return super().ends([r for r in rows if not cls._shaped(r[1], r[3])])

    def evidence(self, words: list[str]):
        """(0, word): the words typed that are the word of an item with the number beside them, if there are two words."""
        numbers = [w.lstrip("0") for w in words if w.isdigit()]
        rest = [w for w in words if not w.isdigit()]
        if len(numbers) == 1 and len(rest) == 2:
            cores = {c for _, c in self.by_number.get(numbers[0], ())}
            yield from ((0, w) for w in rest if w in cores)

    @staticmethod
    def told(words: list[str], found: list[tuple]) -> str:
        cores = {w for _, w in found}
        others = [w for w in words if not w.isdigit() and w not in cores]
        return f" {others[0]}" if cores and others else ""

    def added_forms(self) -> Counter:
        return Counter({"": 2})

    @staticmethod
    def _parts(s: str):
        """(word, number) of a spelling with the number last or first."""
        for pattern in (r"(.*?[a-z])([0-9]+)()", r"()([0-9]+)([a-z].*)"):
            if m := re.fullmatch(pattern, s):
                yield m[1] + m[3], m[2].lstrip("0")

    def _by_code(self, typed: list[list[str]]) -> list[dict]:
        return [dict([self.number_codes[s]]) if (s := "".join(w)) in self.number_codes else {} for w in typed]

    def _by_number_code(self, typed: list[list[str]]) -> list[dict]:
        return [dict(next(([self.number_codes[w + n]] for w, n in self._parts("".join(words)) if w + n in self.number_codes), ())) for words in typed]

    def _by_number(self, typed: list[list[str]]) -> list[dict]:
        out: list[dict] = [{} for _ in typed]

        def ways():
            for i, words in enumerate(typed):
                for word, number in self._parts("".join(words)):
                    for ref, core in self.by_number.get(number, ()):
                        if word == core:
                            out[i][ref] = 0.0
                        elif core in words and len(words) <= 3:  # another word beside an exact name
                            out[i][ref] = min(OTHER_WORD, out[i].get(ref, np.inf))
                        else:
                            for w in (core, *(x + core for x in self.added), *(core + x for x in self.added)):
                                if len(word) <= 3 * len(w) + 20:  # longer ones cost more than any match may
                                    yield (i, ref, len(core)), word, w, None, 0.0 if w == core else 0.1

        for (i, ref, n), _, _, c in _compared(ways()):
            if c <= MOST_CORE * n + 0.2:
                out[i][ref] = min(c, out[i].get(ref, np.inf))
        return out


def attributed(spellings: DataFrame, reference: DataFrame, ref_field: str, kind: type[Reference] = Reference, missing: tuple = ("unknown", "unk", "none", "na", "nan", "null")) -> DataFrame:
    """Each distinct spelling with the item it means: spelling, n_rows, ref_id, ref_label, cost.

    ``spellings`` has (spelling), ``reference`` (ref_id, ref_field,
    ref_label, short_form, also_known); other columns are ignored. Null and
    empty spellings and words for "unknown" mean nothing; spellings that mean
    no item are not given. Ties go to the more frequent, then the smaller id.
    Of repeated ids the least label counts. An empty reference gives no rows. One of
    more than MAX_REFERENCE items is compared block by block, and learned words
    that add more than MAX_FORMS forms piece by piece, with the same rows as if
    all were compared at once.

    Method: a noisy channel. Spellings are counted alike if they have the same
    words. Those written as an item may be (its label or code, with words
    dropped or reordered) are ranked by frequency: they are the candidates,
    tied to their items, and their frequencies the prior; an item that nobody
    writes so is a candidate of no frequency. Words typed in place of given
    names and words added to models are learned from spellings that are else
    exact. Every other spelling is compared with the candidates that share
    enough pairs of letters with it, which gives the likelihood of its
    cheapest way through the channel (typing errors, abbreviated, dropped and
    reordered words), and attached to the item of the largest posterior.
    Spellings of any length are compared, but for those longer than the
    allowed cost lets any form become.
    """
    spark = spellings.sparkSession
    listed = reference.filter(F.col("ref_field") == ref_field).select(F.col("ref_id").cast("bigint").alias("ref_id"), "ref_label", "short_form", "also_known").dropna(subset=["ref_id", "ref_label"])
    listed = listed.groupBy("ref_id").agg(F.min(F.struct("ref_label", "short_form", "also_known")).alias("r")).select("ref_id", "r.*")
    blocks = max(1, -(-listed.count() // MAX_REFERENCE))
    if blocks > 1:
        listed = stage(listed, "reference")

    def normal(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(_words(s)) for s in b.column(0).to_pylist()])], names=["spelling", "n_rows", "words"])

    distinct = spellings.select("spelling").filter(F.length(F.trim("spelling")) > 0).groupBy("spelling").agg(F.count("*").alias("n_rows"))
    # the work per row is large and the rows are few: spread by number, not by size
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    known = stage(distinct.mapInArrow(normal, "spelling string, n_rows bigint, words string").filter(F.col("words") != ""), "normal_spellings")
    forms = stage(known.groupBy("words").agg(F.sum("n_rows").alias("n")), "spelled_words") if blocks > 1 else known.groupBy("words").agg(F.sum("n_rows").alias("n"))
    pairs = _all_costs(forms, listed, blocks, width, kind, missing)
    as_written = pairs.groupBy("words").agg(F.min(F.struct("cost", "ref_id", "n")).alias("b")).filter(F.col("b.cost") <= AS_WRITTEN)
    prior = as_written.groupBy("b.ref_id").agg(F.sum("b.n").alias("n_written"))
    candidates = listed.select("ref_id", "ref_label").join(prior, "ref_id", "left")
    candidates = F.broadcast(candidates) if blocks == 1 else candidates
    score = F.log(F.coalesce("n_written", F.lit(0)) + 0.5) - SHARPNESS * F.col("cost")
    top = F.max(F.struct(score.alias("score"), (-F.col("ref_id")).alias("first"), "ref_id", "ref_label", "cost")).alias("m")
    best = pairs.join(candidates, "ref_id").groupBy("words").agg(top)
    return known.join(best, "words").select("spelling", "n_rows", "m.ref_id", "m.ref_label", "m.cost")


def _all_costs(forms: DataFrame, listed: DataFrame, blocks: int, width: int, kind: type[Reference], missing: tuple) -> DataFrame:
    """(words, n, ref_id, cost): what each spelling (words, n) may mean among the items of all blocks."""
    spark = forms.sparkSession
    spread = forms.repartition(width)
    counts = forms.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    tails = None
    if blocks > 1:
        counts = stage(counts, "word_counts")

        def ends(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(kind.ends(list(zip(*[c.to_pylist() for c in b.columns]))), pa.string())], names=["tail"])

        tails = stage(listed.mapInArrow(ends, "tail string").groupBy("tail").agg(F.count("*").alias("n")), "label_ends")

    def block(i: int) -> tuple:
        """Items, spellings that have each word of their labels, and labels of the whole reference that end as theirs do (None if these are all)."""
        rows = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == i)
        items = [tuple(r) for r in sorted(rows.collect(), key=lambda r: r.ref_id)]
        in_labels = spark.createDataFrame([(w,) for w in sorted({w for _, label, *_ in items for w in _words(label)})], "word string")
        typed = {r.word: r.n for r in counts.join(F.broadcast(in_labels), "word").collect()}  # words of the block
        if blocks == 1:
            return items, typed, None
        own = spark.createDataFrame([(t,) for t in sorted(set(kind.ends(items)))], "tail string")
        return items, typed, {r.tail: r.n for r in tails.join(F.broadcast(own), "tail").collect()}

    first = block(0) if blocks == 1 else None
    told = _learned(spread, [first] if blocks == 1 else map(block, range(blocks)), blocks, kind)

    def pieces(items: list, typed: dict, ends: dict | None) -> list[DataFrame]:
        """What is learned (given, word) for these items, in pieces that add MAX_FORMS forms or so each."""
        added = kind(items, None, typed, ends).added_forms()
        own = told.join(F.broadcast(spark.createDataFrame([(g,) for g in sorted(added)], "given string")), "given")
        n = {r.given: r.n for r in own.groupBy("given").agg(F.count("*").alias("n")).collect()}
        parts = max(1, min(sum(n.values()), -(-sum(added[g] * k for g, k in n.items()) // MAX_FORMS)))
        return [own] if parts == 1 else [own.filter(F.pmod(F.xxhash64("given", "word"), F.lit(parts)) == k) for k in range(parts)]

    def built(b: tuple, piece: DataFrame | None) -> Reference:
        learned: dict[str, set] = {}
        for r in piece.collect() if piece is not None else ():
            learned.setdefault(r.given, set()).add(r.word)
        return kind(b[0], learned, *b[1:])

    if blocks == 1:
        parts = pieces(*first)
        if len(parts) == 1:
            return _costs(spread, built(first, parts[0]), "candidates", missing)
    # the phases of Reference.candidates, each over all blocks and pieces before the next
    left, found = stage(forms, "spellings_left"), None
    for phase in kind.PHASES:
        costs, fits = None, None
        if phase == "_channel" and blocks > 1:
            for i in range(blocks):
                part = _nearest(left.repartition(width), built(block(i), None))
                fits = part if fits is None else fits.unionByName(part)
            left = stage(left.join(fits.groupBy("words").agg(F.min("best").alias("best")), "words").select("words", "n", "best"), "spellings_left")
        for i in range(blocks):
            b = first if blocks == 1 else block(i)
            for piece in pieces(*b) if phase in kind.LEARNING else [None]:
                part = _costs(left.repartition(width), built(b, piece), phase, missing)
                costs = part if costs is None else costs.unionByName(part)
        least = F.min(F.struct("ref_id", "cost")).alias("r")
        costs = costs.groupBy("words", "n").agg(least) if phase in kind.FIRST else costs.groupBy("words", "n", F.col("ref_id").alias("ref")).agg(least)
        costs = stage(costs.select("words", "n", "r.ref_id", "r.cost"), "phase_costs")
        found = costs if found is None else found.unionByName(costs)
        left = stage(left.join(costs.select("words").distinct(), "words", "left_anti"), "spellings_left")
    return found


def _learned(forms: DataFrame, parts, blocks: int, kind: type[Reference]) -> DataFrame:
    """(given, word): what the spellings tell about the items of all ``parts``, from LEARN_FROM spellings or more each."""
    spark = forms.sparkSession

    def tell(batches):  # of the only block
        import pyarrow as pa

        for b in batches:
            words = [x.split(" ") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for w in words if (t := kind.told(w, list(plain.value.evidence(w))))], pa.string())], names=["t"])

    def say(batches):  # of one of several blocks
        import pyarrow as pa

        for b in batches:
            said = [(x, *e) for x in b.column(0).to_pylist() for e in plain.value.evidence(x.split(" "))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in said], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["words", "ref_id", "told"])

    def conclude(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([t for x, said in rows if (t := kind.told(x.split(" "), [(e["ref_id"], e["told"]) for e in said]))], pa.string())], names=["t"])

    said = told = None
    for items, typed, ends in parts:
        plain = spark.sparkContext.broadcast(kind(items, None, typed, ends))
        if blocks == 1:
            told = forms.select("words").mapInArrow(tell, "t string")
        else:
            part = stage(forms.select("words").mapInArrow(say, "words string, ref_id bigint, told string"), "evidence")
            said = part if said is None else said.unionByName(part)
    if blocks > 1:
        told = said.groupBy("words").agg(F.collect_set(F.struct("ref_id", "told")).alias("said")).mapInArrow(conclude, "t string")
    t = F.split("t", " ")
    return stage(told.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= LEARN_FROM).select(t[0].alias("given"), t[1].alias("word")), "learned_words")


def _nearest(forms: DataFrame, reference: Reference) -> DataFrame:
    """(words, best): ``Reference.nearest`` of each spelling among the items of one block."""
    shared = forms.sparkSession.sparkContext.broadcast(reference)

    def fit(batches):
        import pyarrow as pa

        for b in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            best = shared.value.nearest([w.split(" ") for w in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.float64())], names=["words", "best"])

    out = stage(forms.select("words").mapInArrow(fit, "words string, best double"), "best_fits")
    shared.destroy()
    return out


def _costs(forms: DataFrame, reference: Reference, phase: str, missing: tuple) -> DataFrame:
    """(words, n, ref_id, cost): what a phase finds for each spelling (words, n, with or without best) among these items."""
    shared = forms.sparkSession.sparkContext.broadcast(reference)

    def compare(batches):
        import pyarrow as pa

        for b in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            words = [w.split(" ") for w in b.column(0).to_pylist()]
            found = getattr(shared.value, phase)(words, *[c.to_pylist() for c in b.columns[2:]])
            found = [{} if "".join(w) in missing else c for w, c in zip(words, found)]
            at = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([r for c in found for r in c], pa.int64()), pa.array([float(v) for c in found for v in c.values()], pa.float64())],
                names=["words", "n", "ref_id", "cost"],
            )

    out = stage(forms.mapInArrow(compare, "words string, n bigint, ref_id bigint, cost double"), "channel_costs")
    shared.destroy()
    return out
