"""Personal data: validated patterns, and identifiers found by bootstrapped contexts.

Base spans are the leftmost non-overlapping matches of a pattern for each kind, less those
that a check rejects (ranges, Luhn, digit counts). They seed the extraction, and so do long
lower-case hexadecimal values, for the kind ``secret``, which has no base spans: a value alone
doesn't tell a key from a digest, its context does.

Every token with a digit, an @ or a base span is an occurrence of an instance in lexical
patterns, from the special to the general: the two words before it, the one word before it, and
the mark that this word ends in (``key: ...``, ``key = ...``). A word may stand in the same
token (``mailto:...``, ``ip=...``); words with digits and identifiers count by their class. In
the graph of patterns and instances a pattern's score for a kind is the lower end of the 80 %
Wilson interval of the share of its distinct instances that are of that kind, so a pattern needs
both support and purity, and a general pattern counts where no special one has support. Patterns
that score ``MIN_SCORE`` give their kind to the unseen instances of a fitting shape, and confirm
the secrets among their instances; what is found counts as known in the next round. Rounds end
when one finds nothing. All occurrences of found instances become spans beside the base ones.

Everything is a DataFrame or SQL function. Matching stays inside a row and takes time linear in
its length; the graph holds only identifier-like tokens, aggregated to distinct pairs before any
join. The expressions for matching differ from the plain patterns only in that they cannot take
quadratic time or deep recursion: a match may start only where a leftmost one can.

Nulls and odd rows: a null or empty text has no spans; a null doc_id is kept; repeated rows
give a row each; without seeds nothing is discovered; an empty table gives no rows; other
columns are ignored, or carried by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATOR_RUN, ascii_lower, documents, materialize, running, text_or_empty

#: Kinds of base spans in their order; then the kind that only contexts find.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
EVERY_KIND = (*KINDS, SECRET)
_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    # A local part begins where the last match ended or where no character of one stands before.
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    # Whole chains of 12 to 19 digits with single separators; longer and shorter ones fail anyway.
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: What an unseen instance must look like to become of a kind, besides its digits.
SHAPES = {"email": "^[^@]+@[^@]+$", "ip": "^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){2,7}$", "card": "^[0-9](?:[ ./_-]?[0-9]){11,18}$", "phone": "^[+(]?[0-9][0-9().-]{5,18}$", SECRET: "^[A-Za-z0-9+/_=-]{16,512}$"}
_SECRET_SEED = "^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,128}$"
#: Fixed value: words that announce a digest or a name, not a secret.
NOT_SECRET = "(?:^|[^a-z])(?:sha[0-9]*|md5|digest|checksum|hash|commit|rev|revision|etag|uuid|guid|id)(?:[^a-z]|$)"
MIN_SCORE, Z = 0.55, 1.28
#: Longer instances are told apart by their hashes.
LONGEST = 64
#: Characters for private use: one for a span of each kind, and what stands for them in texts.
_MARKS, _OTHER = "\ue000\ue001\ue002\ue003", "\ue004"
_LEAD = "^(?:[A-Za-z_.-]+[=:]+)?[\"'(\\[<{`]*+"
_TAIL = "(?<![\"')\\]>}.,;:!?`#$%&*|])[\"')\\]>}.,;:!?`#$%&*|]++$"
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(text: str, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches; offsets are code points, ends exclusive."""
    p = _quoted(pattern)
    parts = f"named_struct('gaps', split({text}, {p}, -1), 'hits', regexp_extract_all({text}, {p}, 0))"
    ends = running("transform(m.hits, (h, i) -> length(m.gaps[i]) + length(h))")
    found = "transform(m.hits, (h, i) -> named_struct('start', e[i + 1] - length(h), 'end', e[i + 1], 'value', h))"
    return F.expr(f"transform(array({parts}), m -> transform(array({ends}), e -> {found})[0])[0]")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(value: str) -> str:
    d = "cast(substring(d, length(d) - k, 1) as int)"
    doubled = f"if(k % 2 = 1, {d} * 2 - if({d} > 4, 9, 0), {d})"
    return f"exists(array({_digits(value)}), d -> length(d) between 12 and 19 and aggregate(sequence(0, length(d) - 1), 0, (t, k) -> t + {doubled}) % 10 = 0)"


def _valid(kind: str) -> str:
    if kind == "ip":
        return f"x.value rlike {_quoted(f'^{_BYTE}(?:[.]{_BYTE}){{3}}$')}"
    if kind == "phone":
        return f"length({_digits('x.value')}) between 9 and 15"
    return _luhn("x.value") if kind == "card" else "true"


def _key(text: str = "text") -> list[Column]:
    """What tells rows apart besides doc_id: two hashes of the text."""
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


KEY = ["doc_id", "h1", "h2"]


def _same_key(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.h1 = {b}.h1 and {a}.h2 = {b}.h2")


def merged(spans: str) -> str:
    """SQL: sorted spans without those that begin inside an earlier one, each with ``before``.

    ``before`` is the end of all spans ahead of it, 0 for the first: the text from there to the
    start is free of spans.
    """
    reach = running(f"transform({spans}, x -> x.end)", "greatest({}, {})".format)
    return f"transform(array({reach}), r -> filter(transform({spans}, (x, i) -> named_struct('before', r[i], 'start', x.start, 'end', x.end, 'kind', x.kind, 'rank', x.rank, 'value', x.value)), x -> x.start >= x.before))[0]"


def _cut(start: str, end: str) -> str:
    """SQL: characters of the text whose fixed-width bytes are ``wide``, found without a scan."""
    return f"decode(substring(wide, {start} * 4 + 1, ({end} - {start}) * 4), 'UTF-32')"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, spans (start, rank, end, kind, value) and tokens of every row.

    ``tokens``: (at, word, one, two, seed) of every token with a digit, an @ or a span, with the
    two tokens before it. Spans count as one token each, by a mark that stands for their kind.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *_key(), "text", F.col("text").rlike("[0-9@]").alias("some"))
    needs = {"email": "some and contains(text, '@')", "ip": "some and contains(text, '.')", "card": "some", "phone": "some and contains(text, '+')"}
    for rank, kind in enumerate(KINDS):
        found = F.expr(f"transform(filter(m, x -> {_valid(kind)}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}', 'value', x.value))")
        rows = rows.withColumn("m", F.when(F.expr(needs[kind]), matches("text", PATTERNS[kind]))).withColumn(kind, F.when(F.col("m").isNotNull(), found)).drop("m")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    rows = rows.withColumn("spans", F.array_sort(F.concat(*(F.coalesce(F.col(k), none) for k in KINDS)))).drop(*KINDS)

    plain = f"translate({{}}, '{_MARKS}', '{_OTHER * len(_MARKS)}')".format
    kinds = f"substring('{_MARKS}', g.rank + 1, 1)"
    last = "aggregate(spans, 0, (a, x) -> greatest(a, x.end))"
    clean = f"concat(array_join(transform(groups, g -> concat({plain(_cut('g.before', 'g.start'))}, {kinds})), ''), {plain(_cut('last', 'length(text)'))})"
    with_spans = rows.withColumn("groups", F.expr(f"if(some, {merged('spans')}, null)")).withColumn("last", F.expr(last)).withColumn("wide", F.expr("if(some and size(spans) > 0, encode(text, 'UTF-32'), null)"))
    rows = with_spans.withColumn("clean", F.expr(f"if(some, if(size(spans) > 0, {clean}, {plain('text')}), null)")).drop("wide")
    p = _quoted(SEPARATOR_RUN)
    rows = rows.withColumn("w", F.when(F.col("some"), F.expr(f"split(clean, {p}, -1)"))).withColumn("s", F.when(F.col("some"), F.expr(f"regexp_extract_all(clean, {p}, 0)")))
    n_marks = f"length(x) - length(translate(x, '{_MARKS}', ''))"
    starts = running("transform(w, (x, i) -> length(x) + coalesce(length(get(s, i)), 0))")
    marks_before = running(f"transform(w, x -> {n_marks})")
    # A mark stands for a whole span: what the spans before add to a token's place.
    extra = running("transform(groups, x -> x.end_ - x.start - 1)")
    ends = "transform(groups, (g, i) -> named_struct('start', g.start, 'end_', coalesce(get(groups, i + 1).before, last)))"
    rows = rows.withColumn("at", F.when(F.col("some"), F.expr(starts))).withColumn("n", F.when(F.col("some"), F.expr(marks_before)))
    rows = rows.withColumn("add", F.when(F.col("some"), F.expr(f"transform(array({ends}), groups -> {extra})[0]")))
    token = f"named_struct('at', at[i] + add[n[i]], 'word', w[i], 'one', get(w, i - 1), 'two', get(w, i - 2), 'seed', if(n[i + 1] > n[i], groups[n[i]], null))"
    picked = f"transform(filter(sequence(0, size(w) - 1), i -> w[i] rlike '[0-9@{_MARKS}]'), i -> {token})"
    return rows.select(*KEY, "spans", F.when(F.col("some"), F.expr(picked)).alias("tokens"))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def _class(word: Column) -> Column:
    """A context word as patterns have it: lower case, digits and identifiers by their class."""
    return F.when(word.rlike(f"[{_MARKS}]"), F.lit("<id>")).when(word.rlike("[0-9@]"), F.lit("<number>")).otherwise(ascii_lower(word))


def occurrences(spans: DataFrame) -> DataFrame:
    """KEY, start, end, patterns, instance, kind, fits: identifier-like tokens in their contexts.

    ``kind`` is that of a seed, null for others; ``fits`` has a bit for each kind whose shape the
    instance has.
    """
    rows = spans.filter("size(tokens) > 0").select(*KEY, F.explode("tokens").alias("t"))
    marked = F.col("t.seed").isNotNull()
    lead = F.when(marked, F.regexp_extract("t.word", f"^([^{_MARKS}]*)", 1)).otherwise(F.regexp_extract("t.word", _LEAD, 0))
    rows = rows.withColumn("lead", lead)
    bare = F.regexp_replace(F.expr("substring(t.word, length(lead) + 1)"), _TAIL, "")
    rows = rows.withColumn("bare", F.when(marked, F.col("t.seed.value")).otherwise(bare))
    zero = F.regexp_replace("lead", "[\"'(\\[<{`]", "")
    one, two = F.coalesce("t.one", F.lit("")), F.coalesce("t.two", F.lit(""))
    rows = rows.withColumn("context", F.filter(F.array(_class(zero), _class(one), _class(two)), lambda x: x != ""))
    first, second = F.try_element_at("context", F.lit(1)), F.try_element_at("context", F.lit(2))
    end_mark = F.regexp_extract(F.coalesce(first, F.lit("")), "([=:])$", 1)
    patterns = F.array(F.concat(F.lit("2 "), second, F.lit(" "), first), F.concat(F.lit("1 "), first), F.when(end_mark != "", F.concat(F.lit("0 "), end_mark)))
    rows = rows.withColumn("patterns", F.array_compact(patterns)).withColumn("named", F.array_join(F.slice("context", 1, 2), " "))
    start = F.when(marked, F.col("t.seed.start")).otherwise(F.col("t.at") + F.length("lead"))
    digits = F.length(F.expr(_digits("bare")))
    secret = F.col("bare").rlike("[0-9]") & F.col("bare").rlike("[A-Za-z]") & ~F.col("named").rlike(NOT_SECRET)
    fit = {"email": F.lit(True), "ip": F.lit(True), "card": F.expr(_luhn("bare")), "phone": digits.between(7, 15), SECRET: secret}
    bits = [F.when(F.col("bare").rlike(SHAPES[k]) & fit[k], 1 << i).otherwise(0) for i, k in enumerate(EVERY_KIND)]
    kind = F.when(marked, F.col("t.seed.kind")).when(F.col("bare").rlike(_SECRET_SEED) & secret, F.lit(SECRET))
    instance = F.when(F.length("bare") <= LONGEST, F.col("bare")).otherwise(F.concat_ws(" ", F.lit("#"), F.xxhash64("bare").cast("string"), F.hash("bare").cast("string"), F.length("bare").cast("string")))
    end = start + F.length("bare")
    return rows.filter("bare <> ''").select(*KEY, start.cast("int").alias("start"), end.cast("int").alias("end"), "patterns", instance.alias("instance"), kind.alias("kind"), sum(bits[1:], bits[0]).cast("int").alias("fits"))


def pattern_scores(marked: DataFrame) -> DataFrame:
    """pattern, best, score, all, from distinct (pattern, instance, kind) edges."""
    of = [F.count_if(F.col("kind") == k).alias(k) for k in EVERY_KIND]
    counts = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), *of)
    most, n = F.greatest(*EVERY_KIND), F.col("all")
    best = F.coalesce(*(F.when(F.col(k) == most, F.lit(k)) for k in EVERY_KIND))
    share = most / n
    low = (share + Z * Z / (2 * n) - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return counts.select("pattern", best.alias("best"), low.alias("score"), "all")


def discover(found: DataFrame) -> DataFrame:
    """(instance, found_kind): unseen instances and confirmed secrets, round by round to the last."""
    nodes = found.select(F.explode("patterns").alias("pattern"), "instance", "kind", "fits").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("fits").alias("fits"))
    edges = materialize(nodes, "edges")
    seeds = found.filter("kind is not null").groupBy("instance").agg(F.max("kind").alias("known"))
    known = seeds = materialize(seeds.withColumn("sure", F.col("known") != SECRET), "known")
    bit = F.expr("case " + " ".join(f"when best = '{k}' then {1 << i}" for i, k in enumerate(EVERY_KIND)) + " end")
    while True:
        marked = edges.select("pattern", "instance", "fits").join(known, "instance", "left").select("pattern", "instance", "fits", F.col("known").alias("kind"), F.coalesce("sure", F.lit(False)).alias("sure"))
        good = pattern_scores(marked).filter(F.col("score") >= MIN_SCORE)
        offered = marked.filter("not sure").join(good, "pattern").filter((F.col("fits").bitwiseAND(bit) != 0) & (F.col("kind").isNull() | (F.col("kind") == F.col("best"))))
        new = materialize(offered.groupBy("instance").agg(F.max_by("best", F.struct("score", "best")).alias("known")).withColumn("sure", F.lit(True)), "new")
        if new.isEmpty():  # each round but the last settles instances, so there is a last
            break
        known = materialize(known.join(new, "instance", "left_anti").unionByName(new), "known")
    return materialize(known.filter("sure").join(seeds.filter("sure"), "instance", "left_anti").select("instance", F.col("known").alias("found_kind")), "discovered")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, base (array), all_spans (array) of every row."""
    base = materialize(base_spans(docs), "base")
    seen = materialize(occurrences(base), "occurrences")
    new = discover(seen)
    rank = F.array_position(F.array(*map(F.lit, EVERY_KIND)), F.col("found_kind")).cast("int") - 1
    span = F.struct("start", rank.alias("rank"), "end", F.col("found_kind").alias("kind"), F.col("instance").alias("value"))
    added = seen.filter(f"kind is null or kind = '{SECRET}'").join(new, "instance").select(*KEY, span.alias("x"))
    added = materialize(added.groupBy(*KEY).agg(F.collect_set("x").alias("added")), "added")
    rows = base.alias("b").join(added.alias("a"), _same_key("b", "a"), "left")
    every = F.when(F.col("a.added").isNull(), F.col("b.spans")).otherwise(F.array_sort(F.concat("b.spans", "a.added")))
    return rows.select(*(F.col(f"b.{k}") for k in KEY), F.col("b.spans").alias("base"), every.alias("all_spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars`` renewed.

    Overlapping spans become one mask, named after the first.
    """
    own = [f"__{i}" for i in range(3)]
    keys = dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64(text_or_empty("text").cast("string")), F.hash(text_or_empty("text").cast("string")))))
    marks = find(docs).filter("size(all_spans) > 0").groupBy(*KEY).agg(F.first("all_spans").alias("__spans"))
    marks = materialize(marks, "marks").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(KEY)), "__spans")
    rows = docs.withColumns(keys).join(marks, F.expr("__0 <=> __k0 and __1 = __k1 and __2 = __k2"), "left")
    groups = merged("__spans")
    last = "aggregate(__spans, 0, (a, x) -> greatest(a, x.end))"
    pieces = f"concat(array_join(transform({groups}, g -> concat({_cut('g.before', 'g.start')}, '<', g.kind, '>')), ''), {_cut(last, 'length(text)')})"
    clean = F.expr(f"transform(array(encode(text, 'UTF-32')), wide -> {pieces})[0]")
    rows = rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return rows.select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all_spans").alias("spans"))
