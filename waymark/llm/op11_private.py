"""Operator 11, personal data: patterns, and terms that disclose a protected entity; DataFrame functions only.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers; their
values are the protected entities.  Masking them isn't enough where another
term gives the entity away, so the corpus tells how much a term discloses.
With N distinct texts, n(e) of them with entity e, n(t) with term t, and
n(e, t) in which t stands within ``WINDOW`` characters of e, in bits:

    IC(e) = log N / n(e)        PMI(e; t) = log N n(e, t) / (n(e) n(t))

IC(e) - PMI(e; t) is what a reader who sees t still has to guess of e.  Term t
discloses e if that is at most ``GENERALISE_BITS``, if PMI is at least
``LEAST_BITS``, and if ``LEAST_TEXTS`` different windows in as many different
texts support it: copies of a text or of a signature are one witness.  Every
occurrence of such a term, in any text, becomes a span of kind ``term``, unless
it overlaps a pattern's span.  :func:`sanitise` removes terms that leave at most
``REMOVE_BITS`` and generalises the others to the kind of what they disclose.

Defined results: a null or empty text has no spans; rows are judged one by one,
equal texts alike, whatever their ids; null ids don't matter; an empty table
gives an empty result; other columns are ignored.  Offsets are code points.
Patterns don't backtrack over what they have read, so long texts take linear
time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_lookup, let, settle, settle_table, table

WINDOW = 100
LEAST_TEXTS = 3
LEAST_TERM = 3
LEAST_BITS = 3
GENERALISE_BITS = 1
REMOVE_BITS = 0.25

KINDS = ("email", "ip", "card", "phone")
#: As the contract has them, but possessive; ``\G`` or what stands before says where a leftmost match can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
IP_FITS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Terms are runs of ASCII letters and digits and of anything outside ASCII.
TERM = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = 64
PRUNE_PARTS = 64


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass: from the right, every second digit is doubled."""
    padded = F.lpad(number, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")  # the digit sum of twice the digit
    terms = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.when(k % 2 == 1, F.substr(doubled, k, F.lit(1))).otherwise(F.substr(padded, k, F.lit(1))).cast("int"))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _fits(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(IP_FITS)
    if kind == "card":
        return F.length(_digits(found)).between(13, 19) & _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _value(kind: str, found: Column) -> Column:
    return _lower(found) if kind == "email" else _digits(found) if kind in ("card", "phone") else found


def running(lengths: Column) -> Column:
    """Per element the sum of those before it; runs of ``_RUN`` are summed up first, so that long arrays stay cheap."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def by_run(xs: Column) -> Column:
        n_runs = F.floor((F.size(xs) + _RUN - 1) / _RUN).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_runs), lambda r: add(F.slice(xs, r * _RUN + 1, _RUN)))
        before = let(sums, lambda s: F.transform(s, lambda _, r: add(F.slice(s, F.lit(1), r))))
        return let(before, lambda b: F.transform(xs, lambda _, k: F.get(b, F.floor(k / _RUN).cast("int")) + add(F.slice(xs, (F.floor(k / _RUN) * _RUN + 1).cast("int"), k % _RUN))))

    return let(lengths, by_run)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) of a pattern's matches; before and after are the text up to the next ones."""
    none = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")

    def placed(found: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            lengths = F.transform(found, lambda m, k: F.length(m) + F.length(F.get(parts, k)))

            def one(m: Column, k: Column, sums: Column) -> Column:
                start = F.get(sums, k) + F.length(F.get(parts, k))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"), F.get(parts, k).alias("before"), F.get(parts, k + 1).alias("after"))

            return let(running(lengths), lambda sums: F.transform(found, lambda m, k: one(m, k, sums)))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_parts)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _window_terms(before: Column, after: Column) -> Column:
    """Distinct terms of the two windows; a term that the outer edge cuts is left out."""
    near = lambda c, cut: F.when(F.length(c) > WINDOW, cut(c)).otherwise(c)
    left = near(before, lambda c: F.regexp_replace(F.substr(c, F.length(c) - (WINDOW - 1), F.lit(WINDOW)), f"^[{TERM}]+", ""))
    right = near(after, lambda c: F.regexp_replace(F.substr(c, F.lit(1), F.lit(WINDOW)), f"[{TERM}]+$", ""))
    words = F.split(_lower(F.concat(left, F.lit(" "), right)), f"[^{TERM}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST_TERM))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, witness, terms) of all patterns' spans, by kind as listed, then start.

    ``terms`` stand within the window, ``witness`` is a hash of it.
    """

    def of_kind(k: int, kind: str) -> Column:
        def span(m: Column) -> Column:
            witness = F.xxhash64(F.substr(m["before"], F.greatest(F.length(m["before"]) - (WINDOW - 1), F.lit(1)), F.lit(WINDOW)), F.substr(m["after"], F.lit(1), F.lit(WINDOW)))
            return F.struct(
                F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _value(kind, m["found"]).alias("value"),
                witness.alias("witness"), _window_terms(m["before"], m["after"]).alias("terms"),
            )

        return F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _fits(kind, m["found"])), span)

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def texts_of(docs: DataFrame) -> DataFrame:
    """One narrow row a document: doc_id, ``key`` (digest of the text) and ``base`` spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), base_spans(text).alias("base"))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(_lower(text), f"[^{TERM}]+")), lambda w: F.length(w) >= LEAST_TERM)


def _texts_with(docs: DataFrame, wanted: DataFrame, parts: int = 1) -> DataFrame:
    """term and ``n_t``, how many distinct texts have it, for terms of ``wanted``; with ``parts`` only one text in so many is looked at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.md5(text).alias("key"), text.alias("text"))
    if parts > 1:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == 0)
    each = rows.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    if wanted.count() <= BROADCAST_ROWS:
        held = each.join(F.broadcast(wanted.select("term")), "term").distinct()
        return held.groupBy("term").agg(F.count("*").alias("n_t"))
    counts = each.distinct().groupBy("term").agg(F.count("*").alias("n_t"))  # all terms first, so that no hot term meets the join
    return counts.join(wanted.select("term"), "term")


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Terms that disclose an entity: term, kind of the entity it discloses most of, and the bits ``left`` to guess.

    ``found`` is the settled :func:`texts_of` of ``docs``.  What is counted of
    the corpus: entities, terms near them, and of those terms the texts.  A term
    that already one text in ``PRUNE_PARTS`` shows to be in too many texts isn't
    counted in the others, so what is shuffled follows the entities and not the
    frequent words.
    """
    each = found.select("key", F.explode("base").alias("s")).select("key", "s.kind", "s.value", "s.witness", "s.terms")
    near = each.select("key", "kind", "value", "witness", F.explode("terms").alias("term"))
    pairs = near.groupBy("kind", "value", "term").agg(F.countDistinct("key").alias("_texts"), F.countDistinct("witness").alias("_windows"))
    pairs = settle(pairs.select("kind", "value", "term", F.least("_texts", "_windows").alias("n_et")).where(F.col("n_et") >= LEAST_TEXTS))
    wanted = settle(pairs.groupBy("term").agg((F.max("n_et") * F.lit(2.0**GENERALISE_BITS)).alias("most")))  # in more texts than that, a term discloses nothing
    if wanted.isEmpty():
        return pairs.select("term", "kind", F.lit(0.0).alias("left"))
    surely = _texts_with(docs, wanted, PRUNE_PARTS).join(wanted, "term").where(F.col("n_t") > F.col("most")).select("term")
    wanted = settle(wanted.join(surely, "term", "left_anti"))
    n_texts = found.select("key").distinct().count()
    n_e = each.groupBy("kind", "value").agg(F.countDistinct("key").alias("n_e"))
    n_t = _texts_with(docs, wanted)
    known = pairs.join(n_e, ["kind", "value"]).join(n_t, "term")
    left = F.log2(F.col("n_t") / F.col("n_et"))
    gain = F.log2(F.lit(float(n_texts)) * F.col("n_et") / F.col("n_e") / F.col("n_t"))
    told = known.where((left <= GENERALISE_BITS) & (gain >= LEAST_BITS)).groupBy("term").agg(F.min(F.struct(left.alias("left"), "kind")).alias("m"))
    return settle(told.select("term", "m.kind", "m.left"))


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Per distinct text that has any: ``key`` and the sorted array ``more`` of (start, end, kind, left) of disclosing terms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.md5(text).alias("key"), text.alias("text"))
    seen = rows.select("key", F.explode(_terms(F.col("text"))).alias("term"))
    light = F.broadcast(terms) if n_terms <= BROADCAST_ROWS else terms
    keys = settle(seen.join(light, "term", "left_semi").select("key").distinct())
    n_keys = keys.count()
    held = join_lookup(rows, keys.withColumn("_has", F.lit(True)), ["key"], n_keys, F.col("key")).where("_has").select("key", "text")
    once = settle_table(held.groupBy("key").agg(F.first("text").alias("text")))
    placed = once.select("key", F.explode(matches(F.col("text"), f"[{TERM}]+")).alias("m")).select("key", "m.start", "m.end", _lower(F.col("m.found")).alias("term"))
    named = placed.join(light, "term").select("key", "start", "end", "kind", "left", F.lit(1).alias("is_term"))
    base = join_lookup(found.select("key", "base"), keys.withColumn("_has", F.lit(True)), ["key"], n_keys, F.col("key")).where("_has").select("key", F.explode("base").alias("s")).distinct()
    both = named.unionByName(base.select("key", "s.start", "s.end", "s.kind", F.lit(0.0).alias("left"), F.lit(0).alias("is_term")))
    own = F.col("is_term") == 0
    by = Window.partitionBy("key").orderBy("start", "is_term")
    reach = F.max(F.when(own, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.last(F.when(own, F.col("start")), True).over(Window.partitionBy("key").orderBy(F.desc("start"), F.desc("is_term")).rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    free = both.withColumn("_clear", clear).where("is_term = 1 AND _clear")
    return free.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "left"))).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, ``key``, ``base`` spans and ``more``, the spans of disclosing terms."""
    found = settle_table(texts_of(docs))
    terms = disclosing(docs, found)
    n_terms = terms.count()
    if not n_terms:
        return found.withColumn("more", F.array().cast("array<struct<start:int,end:int,kind:int,left:double>>"))
    more = settle_table(term_spans(docs, found, terms, n_terms))
    joined = join_lookup(found, more, ["key"], more.count(), F.coalesce("doc_id", F.lit(0)))
    return joined.withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:int,left:double>>")))


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns from :func:`find`."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.col("base"))
    more = F.array_join(F.transform("more", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    both = F.concat(base, F.when((F.size("base") > 0) & (F.size("more") > 0), ",").otherwise(""), more)
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"), F.size("more").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and ``clean``: base spans replaced by their kind, disclosing terms generalised (``[email-term]``) or removed.

    Of overlapping base spans the first one, at equal starts the longer, names
    the place; the text up to the end of the last is replaced.
    """
    found = find(docs).select("key", "base", "more").dropDuplicates(["key"])
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("tag")))
    tag = lambda s: F.when(s["left"] <= REMOVE_BITS, "").otherwise(F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("-term]")))
    more = F.transform("more", lambda s: F.struct(s["start"], s["end"], tag(s).alias("tag")))
    # sorted by start, then longest; a span that begins before all earlier ones end is part of theirs
    ordered = F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    cuts = found.select("key", F.posexplode(ordered).alias("k", "s")).select("key", "k", "s.*")
    by = Window.partitionBy("key").orderBy("k")
    reach = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = cuts.withColumn("_new", (F.col("start") >= reach).cast("int")).withColumn("_g", F.sum("_new").over(by))
    merged = cuts.groupBy("key", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("tag", "k").alias("tag"))
    per = settle(merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("cuts")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("key"))
    joined = join_lookup(rows, per, ["key"], per.count(), F.coalesce("doc_id", F.lit(0)))

    def rebuilt(c: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(c, k - 1)["end"])
        parts = F.transform(c, lambda s, k: F.concat(F.substr("text", before(k) + 1, s["start"] - before(k)), s["tag"]))
        return F.concat(F.array_join(parts, ""), F.substr("text", F.element_at(c, -1)["end"] + 1, F.length("text")))

    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(let(F.col("cuts"), rebuilt)).alias("clean"))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SQL_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_LUHN = "list_sum(list_transform(range(1, 21), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr('0246813579', CAST(substr(lpad({d}, 20, '0'), k, 1) AS INT) + 1, 1) AS INT) ELSE CAST(substr(lpad({d}, 20, '0'), k, 1) AS INT) END)) % 10 = 0"


def _sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT key, {k} AS kind, k, m, before, after, start FROM (
          SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY key ORDER BY k) - length(m) AS start FROM (
            SELECT key, k, ms[k] AS m, ps[k] AS before, ps[k + 1] AS after FROM (
              SELECT key, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (
                SELECT key, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS ps FROM t))))"""
        for k, p in enumerate(_SQL_PATTERNS.values())
    )
    lower = "translate({}, '" + _UPPER + "', '" + _LOWER + "')"
    words = lower.format(
        f"(CASE WHEN length(before) > {WINDOW} THEN regexp_replace(substr(before, length(before) - {WINDOW - 1}, {WINDOW}), '^{_SQL_TERM}', '') ELSE before END"
        f" || ' ' || CASE WHEN length(after) > {WINDOW} THEN regexp_replace(substr(after, 1, {WINDOW}), '{_SQL_TERM}$', '') ELSE after END)"
    )
    kind = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS key FROM documents),
t AS (SELECT DISTINCT key, key AS text FROM d),
found AS ({found}),
fits AS (
  SELECT *, CASE kind WHEN 0 THEN {lower.format("m")} WHEN 1 THEN m ELSE ds END AS val
  FROM (SELECT *, CAST(start AS BIGINT) + length(m) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS ds FROM found)
  WHERE CASE kind WHEN 0 THEN true
        WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255)) = 4
        WHEN 2 THEN length(ds) BETWEEN 13 AND 19 AND {_LUHN.format(d="right(ds, 19)")}
        ELSE length(ds) BETWEEN 9 AND 15 END
),
near AS (
  SELECT DISTINCT key, kind, val, witness, term FROM (
    SELECT key, kind, val, right(before, {WINDOW}) || chr(10) || chr(10) || left(after, {WINDOW}) AS witness, unnest(regexp_extract_all({words}, '{_SQL_TERM}')) AS term FROM fits)
  WHERE length(term) >= {LEAST_TERM}
),
pairs AS (SELECT kind, val, term, least(count(DISTINCT key), count(DISTINCT witness)) AS n_et FROM near GROUP BY ALL HAVING n_et >= {LEAST_TEXTS}),
n_e AS (SELECT kind, val, count(DISTINCT key) AS n_e FROM fits GROUP BY ALL),
n_t AS (SELECT term, count(DISTINCT key) AS n_t FROM (SELECT key, unnest(regexp_extract_all({lower.format("key")}, '{_SQL_TERM}')) AS term FROM t) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
told AS (
  SELECT DISTINCT term FROM pairs JOIN n_e USING (kind, val) JOIN n_t USING (term)
  WHERE log2(n_t / n_et) <= {GENERALISE_BITS} AND log2((SELECT count(*) FROM t) * CAST(n_et AS DOUBLE) / n_e / n_t) >= {LEAST_BITS}
),
placed AS (
  SELECT key, {lower.format("m")} AS term, sum(length(before) + length(m)) OVER (PARTITION BY key ORDER BY k) - length(m) AS start, length(m) AS n FROM (
    SELECT key, k, ms[k] AS m, ps[k] AS before FROM (
      SELECT key, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT key, regexp_extract_all(text, '{_SQL_TERM}') AS ms, regexp_split_to_array(text, '{_SQL_TERM}') AS ps FROM t WHERE EXISTS (SELECT * FROM told))))
),
more AS (
  SELECT key, start, start + n AS stop FROM placed p WHERE term IN (SELECT term FROM told)
  AND NOT EXISTS (SELECT * FROM fits f WHERE f.key = p.key AND f.start < p.start + p.n AND f.stop > p.start)
),
b AS (
  SELECT key, string_agg(CASE kind {kind} END || ':' || CAST(start AS BIGINT) || ':' || stop, ',' ORDER BY kind, start) AS s,
         count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3
  FROM fits GROUP BY key
),
x AS (SELECT key, count(*) AS n, string_agg('term:' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start) AS s FROM more GROUP BY key)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone,
       sha256(coalesce(b.s, '')) AS base_sha256, concat_ws(',', b.s, x.s) AS spans, coalesce(x.n, 0) AS n_terms
FROM d LEFT JOIN b USING (key) LEFT JOIN x USING (key)
"""


SQL = _sql()
