"""Secret scans: fixed patterns and character Markov models, with DataFrame functions only.

Three patterns give the base spans.  Beyond them, every long run of key
characters is scored by two first-order Markov models, one of random strings and
one of ordinary identifiers: the log-likelihood ratio per step decides.  The
models are character-pair counts over labelled samples, which all documents
give: base spans of kinds access and hex and the values of assignments that mix
letters and digits are random strings, words of at least ``WORD`` characters
outside base spans are ordinary.  Ratios are whole thousandths, so a score does
not depend on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windfold.llm import common as c

#: Fixed patterns of the base kinds, in the order of the kinds; ASCII letters of the names count in either case.
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Failing short runs need not be listed: a maximal run of the class is either long enough or no match.
HEX_LONG = r"[0-9a-f]{24,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"

#: Characters of the models; all else is one further state.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
STATES = len(ALPHABET) + 1
#: Shortest run that the models score and shortest ordinary word that they learn from.
RUN, WORD = 20, 8
#: Weight, in observations, of a character's share in each step's probability.
BACK = 10
_CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}+"
_ORDINARY = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{{{WORD},}}+(?![A-Za-z0-9+/_=-])"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, value) of the matches of ``pattern``, in code points."""
    # pieces between matches and the matches themselves, in turn, give the positions
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.length(both["gap"])
        end = start + F.length(both["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), both["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)["out"]).otherwise(empty)


def _steps(value: str) -> str:
    """SQL: array of the character pairs of ``value``, as one number each."""
    at = f"transform(split({value}, ''), ch -> locate(ch, '{ALPHABET}'))"
    return f"transform(array({at}), q -> zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (a, b) -> a * {STATES} + b))[0]"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text, base``: the spans of the fixed patterns, by start and kind."""
    text = F.col("_text")
    assign = F.filter(_found(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    out = c.texts(docs, id_col, text_col).select("_id", "_text", assign.alias("_a"), _found(text, ACCESS_LONG, "access").alias("_k"), _found(text, HEX_LONG, "hex").alias("_h"))
    return out.select("_id", "_text", by_start(F.concat("_a", "_k", "_h")).alias("base"))


def outside() -> Column:
    """``_text`` with "0" in place of each base span: a word that meets a span then touches a key character and is not ordinary."""
    cut = """aggregate(base, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
      (z, s) -> named_struct('at', greatest(z.at, s.end), 'out', concat(z.out, array(substring(_text, z.at + 1, greatest(s.start - z.at, 0))))),
      z -> concat(array_join(z.out, '0'), '0', substring(_text, z.at + 1)))"""
    return F.when(F.size("base") == 0, F.col("_text")).otherwise(F.expr(cut))


def markov_model(spans: DataFrame) -> DataFrame:
    """One row ``llr``: thousandths of log-likelihood ratio by character pair (random over ordinary), smoothed.

    ``spans`` as of :func:`base_spans`.  The table has STATES * STATES entries
    at any input size.  Without samples of a kind its steps are uniform.
    """
    value = F.regexp_extract("s.value", ASSIGN, 2)
    random = spans.where(F.size("base") > 0).select(F.explode("base").alias("s")).select(F.when(F.col("s.kind") == "assign", value).otherwise(F.col("s.value")).alias("v"))
    random = random.where(F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]")).select(F.lit(1).alias("y"), "v")
    plain = spans.select(F.explode(F.regexp_extract_all(outside(), F.lit(_ORDINARY), F.lit(0))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    # a word counts once, however often it is written: a very common one must not stand for all
    pairs = random.unionByName(plain.select(F.lit(0).alias("y"), "v")).select("y", F.explode(F.expr(_steps("v"))).alias("p"))
    counts = pairs.groupBy("p").agg(F.sum(F.col("y")).alias("r"), F.sum(1 - F.col("y")).alias("o"))
    every = _all_pairs(spans).join(counts, "p", "left").select("p", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("p", "r", "o"))).alias("t"))
    zero, add = "named_struct('r', 0L, 'o', 0L)", "(z, x) -> named_struct('r', z.r + x.r, 'o', z.o + x.o)"
    states = f"sequence(0, {STATES - 1})"
    rows = f"transform({states}, a -> aggregate(slice(t, a * {STATES} + 1, {STATES}), {zero}, {add}))"
    columns = f"transform({states}, b -> aggregate(filter(t, x -> x.p % {STATES} = b), {zero}, {add}))"
    # a step's probability leans on its second character's share as on BACK observations
    share = lambda k: f"((c[x.p % {STATES}].{k} + 1D) / (z.{k} + {STATES}))"
    chance = lambda k: f"((x.{k} + {BACK}D * {share(k)}) / (n[x.p DIV {STATES}].{k} + {BACK}))"
    ratio = f"CAST(round(1000 * (ln({chance('r')}) - ln({chance('o')}))) AS INT)"
    return one.selectExpr("t", f"{rows} AS n", f"{columns} AS c", f"aggregate(t, {zero}, {add}) AS z").selectExpr(f"transform(t, x -> {ratio}) AS llr")


def _all_pairs(like: DataFrame) -> DataFrame:
    return like.sparkSession.range(0, STATES * STATES, 1, 1).select(F.col("id").cast("int").alias("p"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, base, added``, arrays of (start, end, kind, value).

    ``base`` are the spans of the fixed patterns, ``added`` (kind markov) the
    runs of at least RUN key characters that meet no base span, hold a letter
    and a digit and have at least ``threshold`` nats per step for "random".
    Positions are code points, ends exclusive.  Null and empty texts have no
    spans, rows with the same identifier are scanned one by one, no rows give no
    rows, further columns are ignored.
    """
    spans = base_spans(docs, id_col, text_col)
    model = markov_model(spans).first()
    table = "array(" + ",".join(map(str, model["llr"])) + ")"
    runs = _found(F.col("_text"), _CANDIDATE, "markov")
    free = F.filter(runs, lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    scored = spans.select("_id", "base", free.alias("_free"))
    score = f"aggregate({_steps('r.value')}, 0, (z, p) -> z + _llr[p])"
    out = scored.withColumn("_llr", F.expr(table)).select(c.id_back().alias("doc_id"), "base", F.expr(f"filter(_free, r -> {score} >= {int(1000 * threshold)} * (length(r.value) - 1))").alias("added"))
    return out


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column) -> Column:
    """By start, then in the order of the kinds."""
    kinds = F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("markov"))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("kind"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda x: x["s"])
