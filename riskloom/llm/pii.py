"""PII (operator 5): information-theoretic sanitisation, DataFrame functions only.

Base spans (emails, addresses, cards, phone numbers) are the protected
entities.  A term that keeps company with an entity may give it away: its
disclosure is the pointwise mutual information of term and entity as a share of
the entity's information content,

    disclosure = log(N * n_te / (n_t * n_e)) / log(N / n_e),

with N documents, n_e of them with the entity, n_t with the term, n_te with the
term within ``window`` characters of the entity.  It is 1 when the term never
occurs without the entity.  Terms at ``generalise`` or more are replaced by a
placeholder, at ``remove`` or more deleted, wherever they stand near the
entity.  A pair needs ``support`` different contexts, or two contexts of two
documents that chance hardly brings about; so copies of one document prove
nothing.  With k the smaller number of its contexts and documents, a pair of
independent term and entity gets there with a probability of at most
(n_t * n_e / N) ** k / k!, which times the number of pairs has to be ``chance``
or less.  All counts are over all documents.

Patterns are written without backtracking over runs, so that their time is
linear in the length of any text.

Cases: null text is empty; empty text has no spans; matches that fail their
test (range, Luhn, digit count) are dropped; overlaps of kinds all stay;
repeated rows are handled alike, and rows of one doc_id, or of none, are told
apart by their texts; a text is always read whole; an empty table gives an empty
result; other columns are ignored by ``find_spans`` and kept by ``sanitise``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import durable

#: Possessive forms of the contract's patterns; a run is entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Settings:
    window: int = 80
    #: Contexts that suffice without a test; fewer, two at least, must pass the one of ``chance``.
    support: int = 3
    chance: float = 0.05
    generalise: float = 0.9
    remove: float = 0.97
    min_letters: int = 1
    #: Largest number of candidate terms that is broadcast; above it the join shuffles.
    broadcast_terms: int = 50_000


#: Tests of a match ``x``, as SQL; the expressions below are SQL text, since so many nested ones are slow to build otherwise.
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
TESTS = {
    "email": "true",
    "ip": rf"x.value rlike r'^{_BYTE}(?:\.{_BYTE}){{3}}$'",
    "card": f"if(length({_DIGITS}) between 12 and 19, luhn_check({_DIGITS}), false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "contains({t}, '@')", "ip": r"{t} rlike r'[0-9]\.[0-9]'", "card": r"{t} rlike r'[0-9][\x20-]?[0-9]'", "phone": r"{t} rlike r'\+[0-9]'"}
_CHUNK, _BLOCK = 256, 4096


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(parts: str, start: str, size: str) -> str:
    """The running sums before each part ``x``; for short arrays, since appending copies."""
    nothing = f"named_struct('at', {start}, 'out', cast(array() as array<int>))"
    return f"aggregate({parts}, {nothing}, (a, x) -> named_struct('at', a.at + {size}, 'out', array_append(a.out, a.at)), a -> a.out)"


def positions(text: str, pattern: str) -> str:
    """SQL for the array of (start, end, value) of all matches, in code points: pieces between matches give the gaps.

    Running sums are made over chunks first and then within each, so that time stays linear in the matches.
    """
    size = "length(x.gap) + length(x.hit)"
    pieces = f"filter(zip_with(regexp_extract_all({text}, r'{pattern}', 0), split({text}, r'{pattern}', -1), (h, g) -> named_struct('hit', h, 'gap', g)), x -> x.hit is not null)"
    chunks = f"transform(sequence(1, greatest(size(z), 1), {_CHUNK}), i -> slice(z, i, {_CHUNK}))"
    chunk_size = "aggregate(x, 0, (n, x) -> n + length(x.gap) + length(x.hit))"
    span = "named_struct('start', at + length(x.gap), 'end', at + length(x.gap) + length(x.hit), 'value', x.hit)"
    spans = f"zip_with(p, {_running('p', 's', size)}, (x, at) -> {span})"
    return _bound(pieces, "z", _bound(chunks, "c", f"flatten(zip_with(c, {_running('c', '0', chunk_size)}, (p, s) -> {spans}))"))


def base_spans(text: str) -> Column:
    """Array of (start, kind number, end, value), sorted, for the column named ``text``."""
    kinds = []
    for k, kind in enumerate(KINDS):
        passing = f"filter({positions(text, PATTERNS[kind])}, x -> {TESTS[kind]})"
        one = f"transform({passing}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end, 'value', x.value))"
        kinds.append(f"if({NEEDS[kind].format(t=text)}, {one}, cast(array() as array<struct<start:int,kind:int,end:int,value:string>>))")
    return F.expr(f"array_sort(concat({', '.join(kinds)}))")


def _near(text: str, window: int) -> Column:
    """For each of ``base``: where its window begins (at), what stands left and right of it in the window, and the characters around that.

    The text is cut into blocks first, since any substring has to be counted from the first character on.
    """
    blocks = f"transform(sequence(0, length({text}), {_BLOCK}), i -> substring({text}, i + 1, {_BLOCK}))"
    cut = lambda start, n: f"substring(concat(get(b, {start} div {_BLOCK}), coalesce(get(b, {start} div {_BLOCK} + 1), '')), {start} % {_BLOCK} + 1, {n})"
    at = f"greatest(x.start - {window}, 0)"
    edges = f"'before', if({at} > 0, {cut(f'({at} - 1)', 1)}, ''), 'after', coalesce({cut(f'(x.end + {window})', 1)}, '')"
    one = f"named_struct('at', {at}, 'left', {cut(at, f'least(x.start, {window})')}, 'right', {cut('x.end', window)}, {edges})"
    return F.expr(f"if(size(base) > 0, {_bound(blocks, 'b', f'transform(base, x -> {one})')}, null)")


def find_spans(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, _key (a hash of the text), base (array of spans) and terms (array of start, end, disclosure)."""
    s = s or Settings()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = durable(
        docs.select("doc_id", F.xxhash64(text).alias("_key"), text.alias("_text"))
        .withColumn("base", base_spans("_text"))
        .select("doc_id", "_key", "base", _near("_text", s.window).alias("near"))
    )
    word = rf"\p{{L}}{{{s.min_letters},}}+"
    spans = base.where(F.size("base") > 0).select("doc_id", "_key", F.explode(F.arrays_zip("base", "near")).alias("x"))

    def words(side: str, at: str, cut: str) -> Column:
        """Words of one side, but for one that the edge of the window cuts."""
        whole = rf"filter({positions(f'x.near.{side}', word)}, w -> not ({cut} rlike r'\p{{L}}'))"
        return F.expr(f"transform({whole}, w -> named_struct('term', lower(w.value), 'start', {at} + w.start, 'end', {at} + w.end))")

    near = spans.select(
        "doc_id", "_key", F.col("x.base.value").alias("entity"), F.xxhash64("x.near.left", "x.near.right").alias("_context"),
        F.explode(F.concat(
            words("left", "x.near.at", "if(w.start = 0, x.near.before, '')"),
            words("right", "x.base.end", "if(w.end = length(x.near.right), x.near.after, '')"),
        )).alias("w"),
    ).select("doc_id", "_key", "entity", "_context", "w.*")
    n_e = spans.select("doc_id", "_key", F.col("x.base.value").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    total = F.lit(float(base.count()))
    # documents with the term near any entity: n_t is no smaller, so the disclosure is no larger than with it
    n_near = near.select("term", "doc_id", "_key").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    information = F.log(total / F.col("n_e"))

    def disclosure(n_t: str) -> Column:
        return F.when(information > 0, F.log(total * F.least("n_te", n_t, "n_e") / (F.col(n_t) * F.col("n_e"))) / information)

    n_pairs = near.select("entity", "term").distinct().count()

    def supported(n_t: str) -> Column:
        k = F.least("contexts", "n_te")
        expected = F.col(n_t) * F.col("n_e") / total
        return (F.col("contexts") >= s.support) | ((k >= 2) & (F.pow(expected, k) / F.factorial(F.least(k, F.lit(20)).cast("int")) * n_pairs <= s.chance))

    pairs = durable(
        near.groupBy("entity", "term").agg(F.countDistinct("_context").alias("contexts"), F.countDistinct(F.struct("doc_id", "_key")).alias("n_te"))
        .where(F.col("contexts") >= min(2, s.support))
        .join(n_e, "entity").join(n_near, "term")
        .where((disclosure("n_near") >= s.generalise) & supported("n_near"))
    )
    terms = pairs.select("term").distinct()
    if pairs.count() <= s.broadcast_terms:
        terms = F.broadcast(terms)
    n_t = (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(word), F.lit(0)))).alias("term"))
        .join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    )
    disclosing = (
        pairs.join(n_t, "term").withColumn("disclosure", disclosure("n_t"))
        .where((F.col("disclosure") >= s.generalise) & supported("n_t")).select("entity", "term", "disclosure")
    )
    found = (
        near.join(disclosing, ["entity", "term"]).groupBy("doc_id", "_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_text_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left")
    return joined.select("doc_id", "_key", "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,disclosure:double>>")).alias("terms"))


def labels(base: Column, terms: Column | None = None) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""
    one = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    if terms is not None:
        one = F.concat(one, F.transform(terms, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"))))
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.concat_ws(",", F.transform(F.array_sort(one), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def sanitise(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` sanitised: entities become ``[EMAIL]`` and so on."""
    s = s or Settings()
    spans = find_spans(docs, s).select(F.col("doc_id").alias("_rl_id"), F.col("_key").alias("_rl_key"), F.col("base").alias("_rl_base"), F.col("terms").alias("_rl_terms")).dropDuplicates(["_rl_id", "_rl_key"])
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    edits = F.array_sort(F.concat(
        F.transform("_rl_base", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), F.element_at(tags, x["kind"] + 1).alias("by"))),
        F.transform("_rl_terms", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), F.when(x["disclosure"] >= s.remove, "").otherwise("[TERM]").alias("by"))),
    ))
    text = F.col("text").cast("string")
    done = F.aggregate(
        edits, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, e: F.when(e["start"] < acc["at"], F.struct(F.greatest(acc["at"], -e["stop"]).alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct((-e["stop"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["by"]).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    keyed = docs.withColumn("_rl_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    return (
        keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_rl_id")) & (F.col("_rl_hash") == F.col("_rl_key")), "left")
        .withColumn("text", F.when(F.size("_rl_base") + F.size("_rl_terms") > 0, done).otherwise(F.col("text"))).select(*docs.columns)
    )
