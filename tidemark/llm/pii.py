"""Personal data: validated patterns, and contextual extraction bootstrapped from them, in DataFrame operations only.

Base entities (e-mail, IP address, card, phone) are found by linear-time expressions and validated.  They are the seeds.
Every identifier-like token is a mention with the lexical patterns of its context (the word before it, and the two
words before it); patterns and instances form a bipartite graph.  Each round scores a pattern by the confidence of the
distinct instances it occurs with, and an instance by the patterns it occurs in.  Instances that seeds never named but
that patterns of high confidence introduce are further spans, of kind ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

# Each expression matches what the plain one beside it does.  Possessive repeats keep the matcher from recursing, and
# the look-behind keeps it from trying every start within a run that cannot match; \G is the end of the last match.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT = 48  # characters of context kept on the left of a mention


STEP = 256  # elements that one block of a running value holds


def running(df: DataFrame, column: str, out: str, op: str = "a + x", zero: str = "0L") -> DataFrame:
    """Add ``out``: for each element of an array of longs, ``op`` over the elements before it, from ``zero``.

    Blocks, blocks of their totals, and the totals of those: an array that grows by one element is copied within a block
    only, so the work is linear.  The blocks are columns used twice, which the optimizer leaves as they are;
    what a block starts from reaches it as the other array of a zip, evaluated once.
    """
    held = [f"__{out}_{i}" for i in range(4)]

    def grown(part: str) -> str:
        return f"aggregate({part}, array({zero}), (acc, x) -> concat(acc, array({op.replace('a ', 'element_at(acc, -1) ').replace('(a,', '(element_at(acc, -1),')})))"

    def blocks(whole: str) -> str:
        return f"CASE WHEN size({whole}) = 0 THEN array() ELSE transform(sequence(0, (size({whole}) - 1) div {STEP}), b -> {grown(f'slice({whole}, b * {STEP} + 1, {STEP})')}) END"

    def shifted(parts: str, starts: str) -> str:
        return f"flatten(zip_with({parts}, {starts}, (p, a) -> transform(slice(p, 1, size(p) - 1), x -> {op})))"

    totals = "transform({}, p -> element_at(p, -1))"
    nested = "array<array<bigint>>"
    df = df.withColumn(held[0], F.expr(f"cast({blocks(column)} as {nested})")).withColumn(held[1], F.expr(totals.format(held[0])))
    df = df.withColumn(held[2], F.expr(f"cast({blocks(held[1])} as {nested})")).withColumn(held[3], F.expr(grown(totals.format(held[2]))))
    df = df.withColumn(held[3], F.expr(shifted(held[2], f"slice({held[3]}, 1, size({held[2]}))")))
    return df.withColumn(out, F.expr(shifted(held[0], held[3]))).drop(*held)


def _places(df: DataFrame, text: str, pattern: str, hint: str, out: str, context: bool = False) -> DataFrame:
    """Add ``out``: an array of struct(start, end, found[, left]) of the matches of ``pattern`` in order.

    The pieces between matches give their positions; all lengths are in code points.
    """
    found, gaps, lens, starts = (f"__{out}_{x}" for x in ("found", "gaps", "lens", "starts"))
    has = F.instr(F.col(text), hint) > 0 if hint else F.lit(True)
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(has, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    df = df.withColumn(lens, F.expr(f"transform({found}, (m, i) -> cast(char_length({gaps}[i]) + char_length(m) as bigint))"))
    df = running(df, lens, starts)
    left = f", 'left', right({gaps}[i], {CONTEXT})" if context else ""
    places = (
        f"transform({found}, (m, i) -> named_struct('start', {starts}[i] + char_length({gaps}[i]), "
        f"'end', {starts}[i] + {lens}[i], 'found', m{left}))")
    return df.withColumn(out, F.expr(places)).drop(found, gaps, lens, starts)


def _valid(kind: str, m: str) -> str:
    """SQL condition on the matched string ``m``."""
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND cast(concat('0', right(p, 3)) as int) <= 255)"
    digits = f"array(regexp_replace({m}, '[^0-9]', ''))"
    if kind == "phone":
        return f"exists({digits}, d -> char_length(d) BETWEEN 9 AND 15)"
    if kind == "card":
        digit = "cast(substring(d, char_length(d) - i, 1) as int)"
        luhn = f"aggregate(sequence(0, char_length(d) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {digit} ELSE cast(substring('0246813579', {digit} + 1, 1) as int) END) % 10 = 0"
        return f"exists({digits}, d -> CASE WHEN char_length(d) BETWEEN 12 AND 19 THEN {luhn} ELSE false END)"
    return "true"


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: an array of struct(start, rank, end, kind) in the order of start, then kind as listed."""
    for kind in KINDS:
        df = _places(df, text, PATTERNS[kind], HINTS[kind], f"__{kind}")
    parts = [
        f"transform(filter(__{k}, x -> {_valid(k, 'x.found')}), x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end, 'kind', '{k}'))" for i, k in enumerate(KINDS)]
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*[f"__{k}" for k in KINDS])


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _mentions(rows: DataFrame) -> DataFrame:
    """Rows (row, start, end, token, seed, patterns) of the identifier-like tokens; edges of punctuation are cut off.

    A mention is a seed where a base span overlaps it: along the text, the largest end of the spans that start before its end.
    """
    m = rows.select("row", (F.size("base") > 0).alias("some"), F.explode("mentions").alias("m"))
    edge = r"[\"'(),;:!?.<>\[\]{}|=]"
    m = m.withColumn("lead", F.char_length(F.regexp_extract("m.found", rf"^({edge}*+)", 1)))
    m = m.withColumn("token", F.regexp_replace(F.substr("m.found", F.col("lead") + 1), rf"(?<!{edge}){edge}++$", ""))
    m = m.withColumn("start", F.col("m.start") + F.col("lead")).withColumn("end", F.col("start") + F.char_length("token"))
    words = F.filter(F.split(F.lower(F.regexp_replace("m.left", "[0-9]", "0")), r"\s+"), lambda w: w != "")
    m = m.withColumn("words", words).withColumn("own", F.lower(F.regexp_extract("token", "^([A-Za-z_]+[=:])", 1)))
    one, two = F.element_at("words", -1), F.element_at("words", -2)
    patterns = F.when(F.col("own") != "", F.array(F.col("own"))).when(F.size("words") >= 2, F.array(one, F.concat_ws(" ", two, one)))
    patterns = patterns.when(F.size("words") == 1, F.array(one)).otherwise(F.array().cast("array<string>"))
    m = m.select("row", "start", "end", "token", "some", patterns.alias("patterns"))
    alone = m.filter(~F.col("some")).select("row", "start", "end", "token", F.lit(False).alias("seed"), "patterns")
    spans = rows.filter(F.size("base") > 0).select("row", F.explode("base").alias("x")).select(
        "row", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.start").alias("at"), F.col("x.end").alias("reach"))
    both = m.filter("some").drop("some").withColumn("at", F.col("end") - 1).unionByName(spans, allowMissingColumns=True)
    along = Window.partitionBy("row").orderBy("at", F.col("reach").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("seed", F.coalesce(F.max("reach").over(along) > F.col("start"), F.lit(False))).filter("reach IS NULL")
    return alone.unionByName(near.select(*alone.columns))


def discover(rows: DataFrame, *, rounds: int = 20, confident: float = 0.6, support: int = 3, prior: float = 2.0) -> DataFrame:
    """Columns row, start, end of mentions that patterns of high confidence introduce and no seed covers.

    ``rows`` has row, base and mentions.  A pattern needs ``support`` distinct sure instances; its score is the sum of
    its instances' confidences over their number plus ``prior``.  Instances need six characters, four of them digits.
    Scores only rise from round to round; the rounds end when the confident patterns and, within 0.001, the sum of
    their scores stay as they were, ``rounds`` at most.
    """
    mentions = materialize(_mentions(rows), "mentions")
    edges = mentions.select("token", "seed", F.explode("patterns").alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pattern-instances")
    # written, so that the join below can split an instance that occurs in very many contexts
    seeds = materialize(edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("sure")), "instances")
    sure = seeds
    patterns, before = None, (0, 0.0)
    for turn in range(rounds):
        scored = edges.select("pattern", "token").join(sure, "token").groupBy("pattern").agg(
            (F.sum("sure") / (F.count(F.lit(1)) + prior)).alias("score"), F.sum((F.col("sure") >= confident).cast("int")).alias("support"))
        patterns = materialize(scored.filter((F.col("support") >= support) & (F.col("score") >= confident)).select("pattern", "score"), f"patterns-{turn}")
        now = tuple(patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if now[0] == before[0] and now[1] - before[1] < 0.001:
            break
        before = now
        if turn < rounds - 1:
            reached = edges.join(patterns, "pattern").groupBy("token").agg((1 - F.exp(F.sum(F.log1p(-0.99 * F.col("score"))))).alias("again"))
            sure = seeds.join(reached, "token", "left").select("token", F.greatest("sure", F.coalesce("again", F.lit(0.0))).alias("sure"))
            sure = materialize(sure, f"instances-{turn}")
    like = (F.char_length("token") >= 6) & (F.char_length(F.regexp_replace("token", "[^0-9]", "")) >= 4)
    new = mentions.filter(~F.col("seed") & like).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    return new.join(patterns.select("pattern"), "pattern").select("row", "start", "end").distinct()


def extract(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 20, confident: float = 0.6, support: int = 3) -> DataFrame:
    """Columns id_col, base and spans: arrays of struct(start, rank, end, kind), positions in code points.

    A null text counts as empty and has no spans.  Rows are told apart by a number of their own, so repeated rows and
    null ids keep their own spans; an empty table gives an empty table; further columns are not read.  Spans that the
    method adds have kind ``id`` and rank 4, and overlap no base span.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _places(base_spans(docs), "text", MENTION, "", "mentions", context=True).drop("text")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "entities")
    new = discover(rows, rounds=rounds, confident=confident, support=support)
    rank = len(KINDS)
    span = F.struct("start", F.lit(rank).alias("rank"), "end", F.lit(FOUND).alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(span).alias("more"))
    out = rows.select("row", "id", "base").join(new, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def masked(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``text`` with each of ``spans`` replaced by its kind in angle brackets; overlapping ones become one of the first kind.

    The text is cut into blocks of ``STEP`` characters, so the pieces between spans are read without counting
    characters from its start again.
    """
    some = f"{spans} IS NOT NULL AND size({spans}) > 0"
    df = df.withColumn("__ends", F.expr(f"CASE WHEN {some} THEN transform({spans}, x -> cast(x.end as bigint)) ELSE cast(array() as array<bigint>) END"))
    df = running(df, "__ends", "__from", "greatest(a, x)")
    df = df.withColumn("__cut", F.expr(f"CASE WHEN {some} THEN regexp_extract_all({text}, '(?s).{{1,{STEP}}}', 0) ELSE cast(array() as array<string>) END"))

    def piece(a: str, b: str) -> str:
        i, j = f"cast({a} div {STEP} as int)", f"cast(({b} - 1) div {STEP} as int)"
        whole = f"array_join(slice(__cut, {i} + 2, {j} - {i} - 1), '')"
        first = f"substring(__cut[{i}], cast({a} % {STEP} as int) + 1, CASE WHEN {i} = {j} THEN cast({b} - {a} as int) ELSE {STEP} END)"
        return f"CASE WHEN {a} >= {b} THEN '' WHEN {i} = {j} THEN {first} ELSE concat({first}, {whole}, substring(__cut[{j}], 1, cast(({b} - 1) % {STEP} as int) + 1)) END"

    parts = f"zip_with({spans}, __from, (x, a) -> CASE WHEN x.start >= a THEN concat({piece('a', 'x.start')}, '<', upper(x.kind), '>') ELSE '' END)"
    tail = f"array_join(transform(array(array_max(__ends)), a -> {piece('a', '__length')}), '')"
    df = df.withColumn("__length", F.expr(f"cast(char_length({text}) as bigint)"))
    return df.withColumn(text, F.expr(f"CASE WHEN {some} THEN concat(array_join({parts}, ''), {tail}) ELSE {text} END")).drop("__ends", "__from", "__cut", "__length")


def redact(df: DataFrame, *, text_col: str = "text", rounds: int = 20, confident: float = 0.6, support: int = 3) -> DataFrame:
    """``df`` with the personal data of ``text_col`` masked; all other columns and all rows stay, null texts too."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__whole")
    docs = df.select(whole, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = _places(base_spans(docs), "text", MENTION, "", "mentions", context=True).drop("text")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "entities")
    new = discover(rows.select("row", "base", "mentions"), rounds=rounds, confident=confident, support=support)
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(FOUND).alias("kind"))
    out = rows.select("row", "__whole", "base").join(new.groupBy("row").agg(F.collect_list(span).alias("more")), "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    out = masked(out.select("__whole", F.col(f"__whole.`{text_col}`").alias("__text"), spans.alias("__spans")), "__text", "__spans")
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__whole.`{c}`").alias(c) for c in df.columns])
