"""Operator 10: toxicity by a weighted finite-state pattern grammar.

Words become tags (insult, threat, target, negation, reported speech, quote, clause end,
other). Five small transducers read the tags: insult and threat put weight on a clause,
target raises it, negation and reported speech lower it. Their composition is one
machine, whose states are built as they are met; a clause scores by the weight the
machine gives to its match, not by isolated words. A logistic curve over the clause scores
of a document and its length gives its score.

All weights are learned from a bounded sample of labelled rows, FIT_ROWS rows per class:
insult words and word stems with the log odds of their documents, the factors of the
transducers by likelihood, and the curve. Without labels the built-in words and factors serve.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_slices

FIT_ROWS = 2000
STEMS = (3, 4, 5, 6, 7, 8)  # lengths of the word beginnings that may become a pattern
LEAST_ODDS = 1.5  # lower bound of a learned pattern's log odds, two standard errors below the estimate
MISS_COST = 5.0  # what a pattern's share of clean rows costs against its share of toxic ones
LETTERS = re.compile(r"[^\W\d_]{3,}")
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]+|[\"“”«»]")

#: English, then German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash disgusting clown imbecile jerk bastard fool vermin garbage filthy ugly".split()
INSULTS += "trottel dummkopf abschaum arschloch versager widerlich schwachkopf imbécile connard crétin salaud abruti ordure imbécil estúpido estúpida idiota basura asqueroso cabrón".split()
THREATS = "kill hurt destroy beat murder punch stab burn smash strangle shoot umbringen töten verprügeln erschießen erwürgen tuer frapper brûler étrangler égorger matar golpear quemar estrangular".split()
TARGETS = "you your yours yourself he she him her they them their this that these those people everyone du dich dir euch ihr dein deine tu toi vous votre ils elles tú usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never isn aren wasn don doesn didn neither nor without hardly nicht kein keine keinen niemals ohne jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say wrote writes claimed claims called quoted reported according alleged sagte sagt schrieb behauptete angeblich disait écrit prétend selon dijo dice escribió según".split()
#: Factors of the transducers where no labels teach others, and the values that labels may choose from.
FACTORS = {"threat": 1.4, "near": 1.5, "aimed": 0.5, "negated": 0.3, "reported": 0.5}
CHOICES = {"threat": (0.0, 1.4, 3.0), "near": (1.0, 1.5, 2.0), "aimed": (0.0, 0.5, 1.0), "negated": (0.1, 0.3, 1.0), "reported": (0.2, 0.5, 1.0)}

# Tags.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)


# --- transducers: step(state, tag) -> (next state, operation); states are small tuples or ints ---


def insult_step(state: int, tag: int, f: dict):
    """Each further insult of a clause weighs as much as the first."""
    return (1 if tag == INSULT else state), (("add", 1.0) if tag == INSULT else None)


def threat_step(state: int, tag: int, f: dict):
    """A threat word alone weighs little; a target within two words makes it a threat."""
    if tag == THREAT:
        return 2, ("add", 0.1)
    if tag == TARGET and state:
        return 0, ("add", f["threat"])
    return max(0, state - 1), None


def target_step(state: int, tag: int, f: dict):
    """An insult within three words of a target weighs more, on either side."""
    target, insult = divmod(state, 4)
    if tag == TARGET:
        return 12, (("add", f["aimed"]) if insult else None)
    if tag == INSULT:
        return 3, (("times", f["near"]) if target else None)
    return max(0, target - 1) * 4 + max(0, insult - 1), None


def negation_step(state: int, tag: int, f: dict):
    """A negation lowers what comes within three words."""
    if tag == NEGATION:
        return 3, None
    return max(0, state - 1), (("times", f["negated"]) if state and tag in (INSULT, THREAT) else None)


def report_step(state: int, tag: int, f: dict):
    """Reported or quoted speech lowers the rest of its clause; a second quotation mark ends it."""
    if tag == REPORT:
        return 1, None
    if tag == QUOTE:
        return (2 if state != 2 else 0), None
    return state, (("times", f["reported"]) if state and tag in (INSULT, THREAT) else None)


TRANSDUCERS = (insult_step, threat_step, target_step, negation_step, report_step)


class Grammar:
    """The composition of the transducers: product states, weights multiplied and added per tag."""

    def __init__(self, factors: dict | None = None):
        self.factors = factors or FACTORS
        self.table: dict = {}

    def step(self, state: tuple, tag: int):
        key = (state, tag)
        hit = self.table.get(key)
        if hit is None:
            moved = [f(s, tag, self.factors) for f, s in zip(TRANSDUCERS, state, strict=True)]
            added = sum(op[1] for _, op in moved if op and op[0] == "add")
            factor = 1.0
            for _, op in moved:
                if op and op[0] == "times":
                    factor *= op[1]
            hit = self.table[key] = (tuple(s for s, _ in moved), added * factor)
        return hit

    def clauses(self, tags, weights) -> list[float]:
        """Scores of the matched clauses; weights scales each insult by its pattern's weight."""
        out, total, start = [], 0.0, (0,) * len(TRANSDUCERS)
        state = start
        for tag, w in zip(tags, weights, strict=True):
            if tag == END:
                if total:
                    out.append(total)
                state, total = start, 0.0
                continue
            state, x = self.step(state, tag)
            total += x * w if tag == INSULT else x
        if total:
            out.append(total)
        return out


def tag_of(word: str, model: dict) -> tuple[int, float]:
    w = model["words"].get(word)
    if w is not None:
        return INSULT, w
    for n in STEMS:
        w = model["stems"].get(word[:n]) if len(word) >= n else None
        if w is not None:
            return INSULT, w
    t = FIXED.get(word)
    if t is not None:
        return t, 1.0
    c = word[0]
    return (QUOTE if c in '"“”«»' else END if not c.isalpha() else OTHER), 1.0


FIXED = {w: t for t, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}


def finder(model: dict):
    """An automaton over what can put weight on a clause: a text without any of it has no matched clause."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in (*model["words"], *model["stems"], *THREATS):
        a.add_word(p, p)
    a.make_automaton()
    return a


def tagged(text: str | None, model: dict, automaton) -> tuple[list[int], list[float]]:
    """Tags and pattern weights of a text's words; empty if nothing in it can put weight on a clause."""
    low = (text or "").lower()
    for end, p in automaton.iter(low):
        a = end - len(p)
        if a < 0 or not low[a].isalpha():
            break  # a hit at a word's start: the grammar decides
    else:
        return [], []
    cache, tags, weights = {}, [], []
    for w in WORD.findall(low):
        t = cache.get(w)
        if t is None:
            t = cache[w] = tag_of(w, model)
        tags.append(t[0])
        weights.append(t[1])
    return tags, weights


def match(text: str | None, model: dict, grammar: Grammar, automaton) -> list[float]:
    """Clause scores of one text."""
    return grammar.clauses(*tagged(text, model, automaton))


def describe(clauses: list[float], size: int) -> list[float]:
    """A document's features: presence, saturated sum, strongest clause, number of clauses, matched weight by length."""
    import math

    if not clauses:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    total = sum(clauses)
    return [1.0, 1.0, math.log1p(total), min(3.0, max(clauses)), math.log1p(len(clauses)), math.log1p(1000 * total / (size + 200))]


def word_keys(text: str | None, known=None) -> tuple[dict[str, int], tuple]:
    """How often (2 at most) a text has each (known) word and word beginning (marked *), and a signature that near copies mostly share."""
    from collections import Counter
    from zlib import crc32

    words = Counter(LETTERS.findall((text or "").lower()))
    keys: dict[str, int] = {}
    for w, n in words.items():
        if known is None or w in known:
            keys[w] = min(2, n)
        for m in STEMS:
            if len(w) <= m:
                break
            k = w[:m] + "*"
            if known is None or k in known:
                keys[k] = min(2, keys.get(k, 0) + n)
    raw = [w.encode() for w in words]
    return keys, (min(map(crc32, raw), default=0), min((crc32(w, 1) for w in raw), default=0), min((crc32(w[::-1], 2) for w in raw), default=0))


def learn_patterns(texts: list[str], toxic: list[int]) -> dict:
    """Words and stems that mark toxic rows, by greedy cover, each with its log odds as weight (1 is the strongest).

    A key's evidence is the rows that hold it once, or those that hold it twice: the
    stronger counts. Rows count by signature, so that a word of one much-copied document
    is no evidence. Every pattern adds evidence of its own, so their number is bounded by
    the sample without a cap.
    """
    import math
    from collections import defaultdict

    out = {"words": dict.fromkeys(INSULTS, 1.0), "stems": {}}
    hits, misses, signatures = defaultdict(set), defaultdict(set), (set(), set())

    def add(to, keys, sig):
        for k, n in keys.items():
            for m in range(1, n + 1):
                to[k, m].add(sig)

    for text, y in zip(texts, toxic, strict=True):
        if y:
            keys, sig = word_keys(text)
            signatures[1].add(sig)
            add(hits, keys, sig)
    total = len(signatures[1])
    least = max(4, total // 100)
    hits = {k: s for k, s in hits.items() if len(s) >= least}
    names = {k for k, _ in hits}
    for text, y in zip(texts, toxic, strict=True):
        if not y:
            keys, sig = word_keys(text, names)
            signatures[0].add(sig)
            add(misses, keys, sig)
    clean = len(signatures[0])
    if not total or not clean:
        return out
    sets, odds, cost = {}, {}, {}
    for (k, m), s in hits.items():
        hit, miss = len(s) + 0.5, len(misses.get((k, m), ())) + 0.5
        least_odds = math.log(hit / (total + 1)) - math.log(miss / (clean + 1)) - 2 * math.sqrt(1 / hit + 1 / miss)
        if least_odds > max(LEAST_ODDS, odds.get(k, 0)):
            sets[k], odds[k], cost[k] = s, least_odds, MISS_COST * total * (miss - 0.5) / clean
    strongest = max(odds.values(), default=1.0)
    covered: dict[int, int] = defaultdict(int)
    while sets:
        # A signature that patterns cover already counts a half, a quarter, then no more; of equals the whole word, then the longer stem.
        gain = {k: sum((1, 0.5, 0.25, 0)[min(3, covered[i])] for i in s) - cost[k] for k, s in sets.items()}
        sets = {k: s for k, s in sets.items() if gain[k] >= least}
        if not sets:
            break
        best = max(sets, key=lambda k: (gain[k] * (1 if k.endswith("*") else 1.05), len(k), k))
        rows = sets.pop(best)
        for i in rows:
            covered[i] += 1
        # Beginnings of the stem that add few rows say nothing new.
        sets = {k: s for k, s in sets.items() if not (k.endswith("*") and best.startswith(k[:-1]) and len(s - rows) < least)}
        weight = odds[best] / strongest
        if best.endswith("*"):
            out["stems"][best[:-1]] = weight
            sets = {k: s for k, s in sets.items() if not k.startswith(best[:-1])}
        else:
            out["words"][best] = weight
    return out


def logistic(x, y, weight, l2: float = 0.02, steps: int = 60):
    """Weights of a logistic curve by Newton steps on the penalised, weighted likelihood."""
    import numpy as np

    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_curve(model: dict, texts: list[str], y, weight):
    """(factors, curve): the transducers' factors one by one by the likelihood of the curve fitted with them."""
    import numpy as np

    automaton = finder(model)
    rows = [tagged(t, model, automaton) for t in texts]
    # Only what stands in a clause with weight matters for the factors.
    sizes = [len(t or "") // 6 for t in texts]
    bare = []
    for tags, weights in rows:
        cuts = [-1, *(i for i, t in enumerate(tags) if t == END), len(tags)]
        keep = [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False) if any(t in (INSULT, THREAT) for t in tags[a + 1 : b])]
        bare.append(([t for a, b in keep for t in (*tags[a:b], END)], [w for a, b in keep for w in (*weights[a:b], 1.0)]))

    def fitted(factors):
        grammar = Grammar(factors)
        x = np.array([describe(grammar.clauses(*r), n) for r, n in zip(bare, sizes, strict=True)])
        curve = logistic(x, y, weight)
        z = np.clip(x @ curve, -30, 30)
        return (weight * (np.logaddexp(0, z) - y * z)).sum(), curve

    factors = dict(FACTORS)
    loss, curve = fitted(factors)
    for name, values in CHOICES.items():
        for v in values:
            if v == factors[name]:
                continue
            got = fitted(factors | {name: v})
            if got[0] < loss - 1:  # a change must explain more than chance would
                factors, (loss, curve) = factors | {name: v}, got
    return factors, curve


def held_out(doc_id="doc_id"):
    """True for the fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """The model: patterns and curve, from at most `rows` labelled training rows of each class (by a seeded hash).

    Without a label of either class the built-in words and a default curve serve. Labels
    that are null, repeated or contradictory: the largest of a doc_id's counts.
    Where documents repeat a picked doc_id, at most 4 * rows rows in all are learned from,
    the first by a hash of the text.
    """
    import numpy as np

    fold = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = fold.withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    counts = {int(r["toxic"] > 0): r["count"] for r in fold.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    picked = fold.where("toxic > 0").orderBy("h", "doc_id").limit(rows).unionByName(fold.where("toxic <= 0").orderBy("h", "doc_id").limit(rows)).select("doc_id", "toxic")
    # 2 * rows ids at most: a proven bound for the broadcast.
    sample = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).join(F.broadcast(picked), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic").limit(4 * rows).collect()
    sample.sort(key=lambda r: (r["toxic"], r["text"] or ""))
    texts, toxic = [r["text"] for r in sample], [int(r["toxic"] > 0) for r in sample]
    model = learn_patterns(texts, toxic)
    model["factors"], default = FACTORS, np.array([-4.0, 2.0, 2.0, 1.0, 0.5, 0.0])
    if 0 < sum(toxic) < len(toxic):
        drawn = {1: max(1, sum(toxic)), 0: max(1, len(toxic) - sum(toxic))}
        weight = np.array([counts.get(c, 1) / drawn[c] for c in toxic])
        model["factors"], default = learn_curve(model, texts, np.array(toxic, float), weight / weight.mean())
    model["curve"] = default.tolist()
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses per row; one pass, no shuffle.

    Null and empty texts have no clause and get the curve's base score; very long texts are
    read whole; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its patterns are bounded by the sample

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        grammar, automaton, curve = Grammar(m["factors"]), finder(m), np.array(m["curve"])
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = [match(t, m, grammar, automaton) for t in texts]
                p = 1 / (1 + np.exp(-np.clip(np.array([describe(f, len(t or "") // 6) for f, t in zip(found, texts, strict=True)]) @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "score", "clauses"])

    out = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).mapInArrow(run, "doc_id long, score double, clauses long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that score below 0.5, with docs' own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        grammar, automaton, curve = Grammar(m["factors"]), finder(m), np.array(m["curve"])
        for batch in batches:
            for part in text_slices(batch, at):
                x = np.array([describe(match(t, m, grammar, automaton), len(t or "") // 6) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(x @ curve < 0))

    return docs.mapInArrow(run, docs.schema)
