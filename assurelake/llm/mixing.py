"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: each
margin in turn scales its cells so that the weighted tokens have the margin's target shares, until
all margins agree. The table of cells is small whatever the corpus holds (sources x languages x
topics) and the fitting runs over it alone; tokens are counted once, with partial sums before the
shuffle. A document is then kept with the calibrated probability of its cell: the cell's fitted
weight relative to the largest weight, drawn from a hash of its id, so the same documents are drawn
in any run, on any cluster.

Targets are shares of tokens. A margin may also have caps: shares that a category may not exceed. They
are turned into targets from the measured shares, so the largest source is held down whatever its name.

A topic is decided by anchor terms: the topic with the most different terms in the text, of equals the
first listed; `general` where there are none.

Defined results: a null source or language is the value `unknown`, as is the topic of a text without
words. Categories without a target share what the targets leave, in proportion to what they have; where
the targets of a margin sum to 1, they keep their present share and the targets divide the remainder, so
no category is drawn out for want of a target. Margins that contradict each other leave a deviation,
which every row states. Empty and null texts hold no tokens and get the weight of their cell. Rows that
repeat an id are drawn alike; rows without an id are drawn by their text. Columns of the input that are
named like the results give way to them in mix(); sampled() keeps all columns. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, cut, fresh, small_batches, table

MARGINS = ("source", "lang", "topic")
#: Cells that may reach the driver. Margins with more values than fit are a mistake of the caller.
MAX_CELLS = 200_000
#: Texts read together up to about this many bytes.
TOGETHER = 4_000_000
Targets = dict[str, dict[str, float]]

# Terms that stand for a topic, English, French, German and Spanish
ANCHORS = {
    "legal": "copyright license licence licensed rights reserved warranty liability terms agreement lizenz urheberrecht haftung garantie licencia derechos reservados licence droits réservés",
    "technical": "http https www function class import return null true false api key token password secret server code data error begin private",
    "contact": "email mail phone call tel contact address card visa mastercard write kontakt telefon adresse contacto correo teléfono courriel téléphone",
}
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789", b" " * 42)


def topic_of(words: set[bytes], anchors: list[tuple[str, frozenset[bytes]]]) -> str:
    """The topic of a text with these lower-cased words."""
    best, most = "general", 0
    for name, terms in anchors:
        if (n := len(terms & words)) > most:
            best, most = name, n
    return best


def with_cells(docs: DataFrame, keep: list[str], text_col: str = "text", anchors: dict[str, str] = ANCHORS) -> DataFrame:
    """The columns `keep` of docs, then `_source`, `_lang`, `_topic` and `_tokens` (words of the text), which
    none of `keep` may be named."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in docs.columns else F.lit("unknown")
    small_batches(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in keep]
    text = [] if text_col in keep else [F.col(text_col).alias("_text")]  # it goes to Python once
    rows = docs.select(*own, unknown("source").alias("_source"), unknown("lang").alias("_lang"), *text)
    at, n_out = keep.index(text_col) if text_col in keep else len(keep) + 2, len(keep) + 2
    schema = rows.select(*own, "_source", "_lang").withColumns({"_topic": F.lit(""), "_tokens": F.lit(0).cast("long")}).schema
    names, terms = schema.names, [(n, frozenset(t.encode().split())) for n, t in anchors.items()]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame, TOGETHER, at):
                topics, tokens = [], []
                for text in part.column(at):
                    # bytes are split at ASCII white space only
                    raw = (text.as_py() or "").lower().encode("utf-8", "surrogatepass")
                    n = len(raw.split())
                    tokens.append(n)
                    topics.append(topic_of(set(raw.translate(_PUNCTUATION).split()), terms) if n else "unknown")
                yield pa.RecordBatch.from_arrays([*part.columns[:n_out], pa.array(topics, pa.string()), pa.array(tokens, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def filled(targets: dict[str, float], have: dict[str, float]) -> dict[str, float]:
    """Shares for all categories present: stated ones as stated, the others in proportion to what they
    have of what is left, scaled to sum to 1. Targets that sum to 1 leave nothing: the others then keep
    their present share, and the stated ones are scaled to the remainder."""
    total = sum(have.values())
    stated = {c: targets[c] for c in have if c in targets}
    rest = {c: x for c, x in have.items() if c not in stated}
    if rest and sum(stated.values()) and sum(targets.values()) > 1.0 - 1e-9:
        part = (1.0 - sum(rest.values()) / total) / sum(stated.values())
        stated = {c: x * part for c, x in stated.items()}
    left = max(0.0, 1.0 - sum(stated.values()))
    share = stated | {c: (left * x / sum(rest.values()) if sum(rest.values()) else 0.0) for c, x in rest.items()}
    norm = sum(share.values())
    return {c: x / norm for c, x in share.items()} if norm else {c: x / total for c, x in have.items()}


def capped(share: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """The shares with none above its cap (`*`: of every category); what is cut goes to the others in
    proportion. Caps that leave no room for the whole are raised alike."""
    limit = {c: caps.get(c, caps.get("*", 1.0)) for c in share}
    if (room := sum(limit.values())) < 1.0:
        return {c: x / room for c, x in limit.items()}
    full: set[str] = set()
    while True:
        free = sum(x for c, x in share.items() if c not in full)
        scale = (1.0 - sum(limit[c] for c in full)) / free if free else 1.0
        over = {c for c, x in share.items() if c not in full and x * scale > limit[c] + 1e-12}
        if not over:
            return {c: limit[c] if c in full else x * scale for c, x in share.items()}
        full |= over


def rake(
    cells: list[tuple[str, str, str, float]], targets: Targets, caps: Targets | None = None, rounds: int = 200, tolerance: float = 1e-9
) -> tuple[list[float], float]:
    """Weights of the cells (source, lang, topic, tokens), and the greatest deviation left from a target.

    Every round scales each margin once. Margins that contradict each other (a zero cell in the way)
    leave a deviation; the last weights are then the closest fit on the last margin.
    """
    total = sum(c[3] for c in cells)
    if not total:
        return [1.0] * len(cells), 0.0
    want = []
    for m, name in enumerate(MARGINS):
        have: dict[str, float] = {}
        for c in cells:
            have[c[m]] = have.get(c[m], 0.0) + c[3]
        have = {k: x for k, x in have.items() if x > 0}
        want.append(capped(filled(targets.get(name, {}), have), (caps or {}).get(name, {})))
    weight, off = [1.0] * len(cells), math.inf
    for _ in range(rounds):
        off = 0.0
        for m in range(len(MARGINS)):
            now: dict[str, float] = {}
            for c, w in zip(cells, weight, strict=True):
                now[c[m]] = now.get(c[m], 0.0) + w * c[3]
            off = max([off, *(abs(now.get(k, 0.0) / total - x) for k, x in want[m].items())])
            weight = [w * (want[m].get(c[m], 1.0) * total / now[c[m]] if now[c[m]] > 0 else 1.0) for c, w in zip(cells, weight, strict=True)]
        if off < tolerance:
            break
    return weight, off


def cell_weights(celled: DataFrame, targets: Targets, caps: Targets | None = None) -> DataFrame:
    """(_source, _lang, _topic, weight, probability, deviation) of every cell of with_cells()."""
    spark = celled.sparkSession
    keys = [f"_{m}" for m in MARGINS]
    counted = celled.groupBy(*keys).agg(F.sum("_tokens").alias("n"))
    got = counted.orderBy(*keys).limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    weights, off = rake([(r[0], r[1], r[2], float(r[3])) for r in got], targets, caps)
    most = max(weights, default=1.0) or 1.0
    rows = [(*tuple(r)[:3], w, w / most, off) for r, w in zip(got, weights, strict=True)]
    return spark.createDataFrame(rows, "_source string, _lang string, _topic string, weight double, probability double, deviation double")


def drawn(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key, or of the text where there is no key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.when(key.isNull(), text)), 11).cast("double") * 2.0**-53


RESULTS = ("_source", "_lang", "_topic", "_tokens", "weight", "probability", "deviation", "kept")


def mix(docs: DataFrame, targets: Targets, caps: Targets | None = None, key_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 7) -> DataFrame:
    """The columns `keep` of docs (the key alone, if not given) with `_source`, `_lang`, `_topic`, `_tokens`,
    weight, probability, deviation and kept: whether the calibrated draw keeps the document.

    The texts are read once: what is decided about them is a written table, and the weights meet that."""
    keep = [c for c in ([key_col] if keep is None else keep) if c not in RESULTS]
    draw = fresh("draw", docs.columns)
    celled = cut(with_cells(docs.withColumn(draw, drawn(F.col(key_col), F.col(text_col), seed)), [*keep, draw], text_col), "mixing-cells")
    weights = cell_weights(celled, targets, caps)
    out = celled.join(F.broadcast(weights), [f"_{m}" for m in MARGINS])  # MAX_CELLS rows at most
    return out.withColumn("kept", F.col(draw) < F.col("probability")).select(*keep, *RESULTS)


def sampled(docs: DataFrame, targets: Targets, caps: Targets | None = None, key_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The documents that mix() keeps, with their own columns. The texts stay where they are: their cells are
    found once for the weights and again for the draw."""
    # under names of their own, so that no column of docs clashes with a result
    own = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *[F.col(c) for c in ("source", "lang") if c in docs.columns])
    named = named.withColumn("draw_", drawn(F.col(own[key_col]), F.col(own[text_col]), seed))
    weights = cell_weights(with_cells(named, [], own[text_col]), targets, caps)
    celled = with_cells(named, [*own.values(), "draw_"], own[text_col])
    out = celled.join(F.broadcast(weights), [f"_{m}" for m in MARGINS])  # MAX_CELLS rows at most
    return out.filter("draw_ < probability").select(*[F.col(n).alias(c) for c, n in own.items()])


#: Production targets of the queries: languages towards each other.
TARGETS: Targets = {"lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}}
#: Production caps: no source above a fifth of the tokens, and little of what isn't prose.
CAPS: Targets = {"source": {"*": 0.2}, "topic": {"legal": 0.05, "technical": 0.1, "contact": 0.1}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document."""
    mixed = mix(table(spark, sf_dir, "documents"), TARGETS, CAPS)
    return mixed.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "probability", "deviation", "kept")
