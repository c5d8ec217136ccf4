"""Personal data: detection and information-theoretic sanitisation.

Only DataFrame functions are used. Four base kinds are found by pattern. Then the
terms of the texts that hold one are tested for what they reveal. Entities are the
values found (a kind and its text) and what recurs of them: the kind itself, the
domain of an email, the first three parts of an ip, the issuer digits of a card, the
leading digits of a phone. For an entity e and a term t, with document frequencies
from the whole corpus and over whole texts, the disclosure of e by t is

    PMI(t, e) / IC(e) = ln(N * df(t, e) / (df(t) * df(e))) / ln(N / df(e)),

which is 1 where t occurs with e alone. Terms that occur with e in at least
``min_support`` documents and whose disclosure reaches ``generalise`` become spans of
kind ``term`` wherever they stand in a text that holds e; from ``remove`` on they are
removed rather than generalised. Texts without personal data stay as they are.

Defined results: a null text is the empty text; equal texts get equal spans, and
repeated rows count as documents of their own; extra columns are kept by
``sanitise`` and ignored by ``find``; positions are code points, ends exclusive.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.runtime import materialise, renamed

MIN_SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
KINDS = ("email", "ip", "card", "phone")
#: Terms whose counts are sent to all tasks, at most.
FREQUENT = 1 << 16

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written for a matcher that must not recurse or rescan: a
#: repeated group is possessive, and a match starts at a run's start or where the
#: last match ended (an earlier start in the run would match as well). The card
#: pattern takes maximal runs of 13 to 19 digits at once.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_WORD = r"\p{L}{3,}"
#: Between a run of letters and a run of others.
_EDGE = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"
#: Leading digits of a card and of a phone number that many values share.
CARD_PREFIX, PHONE_PREFIX = 6, 4


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used often."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPANS = "array<struct<s:int,e:int,v:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Matches as array<struct<s, e, v>>: a match starts after the gaps and
    matches before it."""
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + x)

    def placed(found: Column, sizes: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            return _let(total(sizes.g, i + 1) + total(sizes.m, i), lambda s: F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v")))

        return F.transform(found, at)

    def body(found: Column) -> Column:
        sizes = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("g"), F.transform(found, F.length).alias("m"))
        return F.when(F.size(found) > 0, _let(sizes, lambda z: placed(found, z))).otherwise(F.array().cast(_SPANS))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), body)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def check(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2)
            return total + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return _let(F.reverse(_digits(v)), check)


def base_spans(text: Column, kind: str) -> Column:
    """Valid base matches of one kind, array<struct<s, e, v>>."""
    none = F.array().cast(_SPANS)
    found = _spans(text, PATTERNS[kind])
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), found).otherwise(none)
    if kind == "ip":
        return F.filter(found, lambda x: x.v.rlike(_IP_PARTS))
    if kind == "card":
        return F.filter(found, lambda x: _luhn(x.v))
    ok = F.filter(found, lambda x: F.length(_digits(x.v)).between(9, 15))
    return F.when(F.contains(text, F.lit("+")), ok).otherwise(none)


def _entities(b: Column) -> Column:
    """The entities of a base span: its kind, its value, and the part that recurs."""
    part = (
        F.when(b.k == "email", F.substring_index(b.v, "@", -1))
        .when(b.k == "ip", F.substring_index(b.v, ".", 3))
        .otherwise(F.left(_digits(b.v), F.when(b.k == "card", F.lit(CARD_PREFIX)).otherwise(F.lit(PHONE_PREFIX))))
    )
    return F.array(b.k, F.concat_ws(":", b.k, b.v), F.concat_ws("~", b.k, part))


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks for spans, which are sorted by start."""
    state = "struct<at:int,parts:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)

    def blank(a: Column, x: Column) -> Column:
        lo, hi = F.greatest(a.at, x.s), F.greatest(a.at, x.e)
        new = F.array(F.substring(text, a.at + 1, lo - a.at), F.repeat(F.lit(" "), hi - lo))
        return F.struct(hi.alias("at"), F.concat(a.parts, new).alias("parts")).cast(state)

    return F.aggregate(spans, start, blank, lambda a: F.concat(F.array_join(a.parts, ""), F.substring(text, a.at + 1, F.length(text))))


def _scan(df: DataFrame, text: str) -> DataFrame:
    """One pass over the texts: base spans of each kind and, of texts that have
    any, their entities and the text without the spans."""
    t = F.col("__text")
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for k in KINDS:
        out = out.withColumn(k, base_spans(t, k))
    # A second parameter of the inner function would be the index.
    named = lambda k: F.transform(F.col(k), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(k).alias("k"), F.lower(x.v).alias("v")))
    every = F.concat(*map(named, KINDS))
    out = out.withColumn("__base", F.sort_array(every))
    some = F.size("__base") > 0
    out = out.withColumn("__entities", F.when(some, F.array_distinct(F.flatten(F.transform("__base", _entities)))))
    return out.withColumn("__mask", F.when(some, _masked(t, F.col("__base")))).withColumn("__id", F.when(some, F.md5("__text"))).drop("__base")


def _holders(scanned: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame]:
    """Entities that recur, DataFrame[entity, df_e], and the different texts that
    hold one, DataFrame[__id, __mask, n, entities] with those entities and their
    counts; n documents have the text. Entities of fewer documents support no term."""
    hold = scanned.where("__id is not null")
    held = hold.select("__id", F.explode("__entities").alias("entity")).groupBy("__id", "entity").agg(F.count("*").alias("n"))
    held = materialise(held, "pii-entities")
    entity = held.groupBy("entity").agg(F.sum("n").alias("df_e")).where(F.col("df_e") >= min_support)
    known = held.join(entity, "entity").groupBy("__id").agg(F.first("n").alias("n"), F.collect_list(F.struct("entity", "df_e")).alias("entities"))
    masks = hold.groupBy("__id").agg(F.first("__mask").alias("__mask"))
    return entity, materialise(masks.join(known, "__id"), "pii-texts")


def _rows(texts: DataFrame, counts: DataFrame, n: int, generalise: float) -> DataFrame:
    """DataFrame[__id, n, entity, term] of the terms of texts that may reveal an entity.

    A term is in no more texts with an entity than either is in. Where even that many
    leave the disclosure too small, the pair is dropped before anything is shuffled. This
    is told by the counts of the FREQUENT most frequent terms; other terms all go on.
    """
    frequent = counts.orderBy(F.desc("df_t"), "term").limit(FREQUENT)
    terms = F.array_distinct(F.transform(F.regexp_extract_all("__mask", F.lit(_WORD), F.lit(0)), F.lower))
    rows = texts.select("__id", "n", "entities", F.explode(terms).alias("term")).join(F.broadcast(frequent), "term", "left")

    def may(x: Column) -> Column:
        ic = F.log(F.lit(float(n)) / x.df_e)
        most = F.log(F.lit(float(n)) * F.least(F.col("df_t"), x.df_e) / (F.col("df_t") * x.df_e))
        return F.col("df_t").isNull() | (ic <= 0) | (most >= generalise * ic - 1e-9)

    return rows.select("__id", "n", F.explode(F.filter("entities", may)).alias("x"), "term").select("__id", "n", "x.entity", "term")


def disclosing(entity: DataFrame, rows: DataFrame, counts: DataFrame, n: int, min_support: int, generalise: float, remove: float) -> DataFrame:
    """DataFrame[entity, term, disclosure, remove] of terms that reveal entities.

    Counts of terms and entities are summed per task before they are shuffled.
    The candidates are written first, so the optimizer sees their true size when
    it chooses the join with the counts of all words.
    """
    pairs = rows.groupBy("entity", "term").agg(F.sum("n").alias("df_te"))
    pairs = pairs.where(F.col("df_te") >= min_support).join(entity, "entity")
    pairs = materialise(pairs, "pii-pairs")
    ic = F.log(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log(F.lit(float(n)) * F.col("df_te") / (F.col("df_t") * F.col("df_e")))
    out = pairs.join(counts, "term").withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    return out.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure", (F.col("disclosure") >= remove).alias("remove"))


def _among(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` may be among the wanted ones: they meet a bitmap of hashes, in
    256 pieces of 4 KB however many are wanted, before the join that is exact."""
    hashed = F.pmod(F.xxhash64(*by), F.lit(1 << 23))
    piece, bit = F.shiftright(hashed, 15).alias("__piece"), hashed.bitwiseAND(F.lit((1 << 15) - 1)).alias("__bit")
    bits = wanted.select(piece, bit).groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    met = rows.select("*", piece, bit).join(F.broadcast(bits), "__piece")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.pmod(F.col("__bit"), F.lit(8)).cast("int")) == 1).select(rows.columns)


def _placed(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """DataFrame[__id, s, e, remove]: where the terms (__id, term, remove) stand."""
    texts = texts.select("__id", "__mask").join(terms.select("__id").distinct(), "__id", "left_semi")
    texts = texts.repartition("__id")  # here, before a text becomes a row for each of its runs
    runs = texts.select("__id", F.posexplode(F.split("__mask", _EDGE, -1)).alias("pos", "run")).withColumn("e", F.sum(F.length("run")).over(Window.partitionBy("__id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    runs = runs.where(F.col("run").rlike(_WORD)).select("__id", F.lower("run").alias("term"), (F.col("e") - F.length("run")).alias("s"), "e")
    return runs.join(terms, ["__id", "term"]).select("__id", "s", "e", "remove")


def _found(plain: DataFrame, text: str, keep: list[str], min_support: int, generalise: float, remove: float) -> DataFrame:
    """``keep`` columns, spans by kind, and ``__terms`` array<struct<s, e, remove>>.
    The names of columns are those that ``renamed`` gives."""
    plain = plain.select(*dict.fromkeys([*keep, text]))
    whole = _scan(plain, text).drop("__text", *([] if text in keep else [text]))
    scanned = materialise(whole, "pii-scan")
    n = scanned.count()
    entity, texts = _holders(scanned, min_support)
    words = plain.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0)))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("df_t"))
    # A term is counted with no entity more often than it is in texts.
    counts = materialise(counts.where(F.col("df_t") >= min_support), "pii-words")
    rows = _rows(texts, counts, n, generalise)
    reveal = materialise(disclosing(entity, rows, counts, n, min_support, generalise, remove), "pii-terms")
    rows = _among(rows, reveal, ["entity", "term"])
    terms = rows.join(reveal, ["entity", "term"]).groupBy("__id", "term").agg(F.max("remove").alias("remove"))
    terms = _placed(texts, materialise(terms, "pii-placed"))
    terms = terms.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "remove"))).alias("__terms"))
    # Rows without personal data have no id and stay out of the join.
    none = F.array().cast("array<struct<s:int,e:int,remove:boolean>>")
    out = scanned.where("__id is not null").join(terms, "__id", "left").withColumn("__terms", F.coalesce("__terms", none))
    out = out.unionByName(scanned.where("__id is null").withColumn("__terms", none))
    return out.select(*keep, *KINDS, "__terms")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """DataFrame[key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans]."""
    work, _, (k, t) = renamed(docs, key, text)
    found = _found(work, t, [k], min_support, generalise, remove)
    line = lambda k, xs: F.transform(xs, lambda x: F.concat_ws(":", F.lit(k), x.s, x.e))
    base = F.concat(*(line(k, F.col(k)) for k in KINDS))
    rows = found.withColumn("__b", base).withColumn("__all", F.concat("__b", line("term", F.col("__terms"))))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(F.col(k).alias(key), *counts, F.size("__terms").cast("long").alias("n_term"), F.sha2(F.concat_ws(",", "__b"), 256).alias("base_sha256"), F.concat_ws(",", "__all").alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows with base spans replaced by ``[KIND]``, disclosing terms by
    ``[TERM]`` or by nothing. Overlapping spans are replaced as one, under the
    mark of the first. A null text stays null."""
    work, names, (at,) = renamed(docs, text)
    found = _found(work, at, work.columns, min_support, generalise, remove)
    t = F.col(at)
    mark = lambda xs, m: F.transform(xs, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), (F.lit(m) if isinstance(m, str) else m(x)).alias("m")))
    marks = [mark(F.col(k), f"[{k.upper()}]") for k in KINDS] + [mark(F.col("__terms"), lambda x: F.when(x.remove, F.lit("")).otherwise(F.lit("[TERM]")))]
    state = "struct<at:int,parts:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)

    def cut(a: Column, x: Column) -> Column:
        new = F.concat(a.parts, F.array(F.substring(t, a.at + 1, x.s - a.at), x.m))
        return F.when(x.s >= a.at, F.struct(x.e.alias("at"), new.alias("parts"))).otherwise(F.struct(F.greatest(a.at, x.e).alias("at"), a.parts.alias("parts"))).cast(state)

    end = lambda a: F.concat(F.array_join(a.parts, ""), F.substring(t, a.at + 1, F.length(t)))
    marked = found.withColumn("__m", F.sort_array(F.concat(*marks)))
    clean = F.when(F.size("__m") > 0, F.aggregate(F.col("__m"), start, cut, end)).otherwise(t)
    return marked.withColumn(at, clean).select(work.columns).toDF(*names)
