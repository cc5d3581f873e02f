"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

The sentences of a text, as they stand in its lines and in its paragraphs with
the line ends and comment signs taken out, become sparse TF-IDF vectors, with
document frequencies counted over all texts. The nearest templates (sentences
of licence texts and notices, names, identifiers) by cosine name the licence.
A file without one of its own takes that of the nearest directory above it that
holds a licence file, by joins on path prefixes.

Only sentences that can reach the least cosine are compared. By the inequality
of Cauchy and Schwarz such a sentence holds terms with at least the square of
that cosine of a template's squared weights; so it holds one of the template's
rarest terms, as many as leave less than that share to the others; and its
terms' greatest shares of any template add up to it.

Only DataFrame operations are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm.licence_texts import templates as known_templates
from fundloom.llm.shared import Scratch, materialise

FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|copyright)([._-].*)?$"
TERM = r"[a-z0-9]+"
LEAST_COSINE = 0.6
#: Share of a text's terms in its licence sentences from which the file counts as a licence file, besides those by name.
LEAST_SHARE = 0.5
#: A line end in a paragraph, with the comment signs before the next line.
LINE_END = r"[ \t\r]*\n[ \t]*[#*/;%-]*[ \t]*"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _sentences(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(p, r"([.!?])\s+", "$1\n"), "\n")))


def line_sentences(text: Column) -> Column:
    """Parts of a text between line ends and ends of sentences."""
    return _sentences(F.split(text, "\n"))


def paragraph_sentences(text: Column) -> Column:
    """Sentences of the paragraphs, whose lines are joined; empty lines part paragraphs, with or without a comment sign."""
    return _sentences(F.transform(F.split(text, r"\n[ \t\r#*/;%-]*\n"), lambda p: F.regexp_replace(p, LINE_END, " ")))


def _weights(rows: list[tuple[str, str, str | None]], idf: dict[str, float]) -> list[tuple]:
    """(template, licence, term, weight, must, norm, n_must) of the templates."""
    out = []
    for k, (licence, text, must) in enumerate(rows):
        tf = Counter(_plain_terms(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        out += [(k, licence, t, n * idf[t], int(t == must), norm, int(must is not None)) for t, n in tf.items()]
    return out


def _plain_terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def key_terms(rows: list[tuple[str, str, str | None]], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a sentence holds one, at least, if its cosine to a template is ``least`` or more."""
    keys = set()
    for licence_rows in _grouped(_weights(rows, idf)):
        required = [t for t, _, must in licence_rows if must]
        if required:
            keys.add(required[0])
            continue
        left = total = sum(w * w for _, w, _ in licence_rows)
        for t, w, _ in sorted(licence_rows, key=lambda x: (-idf[x[0]], x[0])):
            # A little less than the share, so that rounding loses nothing.
            if left < 0.999 * least * least * total:
                break
            keys.add(t)
            left -= w * w
    return sorted(keys)


def share_levels(rows: list[tuple[str, str, str | None]], idf: dict[str, float], levels: int = 8) -> list[tuple[list[str], float]]:
    """Terms by their greatest share of a template's squared weights, in levels of (terms, the greatest share in the level).

    What a sentence's terms can have of one template is at most the sum of
    their levels' shares.
    """
    greatest: dict[str, float] = defaultdict(float)
    for terms in _grouped(_weights(rows, idf)):
        total = sum(w * w for _, w, _ in terms)
        for t, w, _ in terms:
            greatest[t] = max(greatest[t], w * w / total)
    ordered = sorted(greatest, key=lambda t: (greatest[t], t))
    size = -(-len(ordered) // levels)
    return [(ordered[i : i + size], greatest[ordered[min(i + size, len(ordered)) - 1]]) for i in range(0, len(ordered), size)]


def _grouped(weights: list[tuple]) -> list[list[tuple]]:
    by = defaultdict(list)
    for k, _, t, w, must, _, _ in weights:
        by[k].append((t, w, must))
    return list(by.values())


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) for each term of ``texts(text)``: in how many of them it is, summed where they arise."""
    return texts.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _idf(df: Column, total: int) -> Column:
    return F.log((F.lit(total) + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0


def nearest_templates(units: DataFrame, frequencies: DataFrame, total: int, spark: SparkSession, weights: list[tuple], least: float = LEAST_COSINE) -> DataFrame:
    """(unit, licence, cosine): for each of ``units(unit, body)`` the nearest templates' licences, if they are near enough.

    Licences whose templates are equally near (to six digits) are all returned.
    """
    template = F.broadcast(spark.createDataFrame(weights, "template int, licence string, term string, w double, must int, norm double, n_must int"))
    counted = units.select("unit", F.explode(terms_of(F.col("body"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    mine = counted.join(frequencies, "term", "left").select("unit", "term", (F.col("tf") * _idf(F.col("df"), total)).alias("u"))
    length = F.sqrt(F.sum(F.col("u") * F.col("u")))
    vectors = mine.groupBy("unit").agg(length.alias("unit_norm"), F.collect_list(F.struct("term", "u")).alias("v"))
    terms = vectors.select("unit", "unit_norm", F.explode("v").alias("x")).select("unit", "unit_norm", "x.term", "x.u")
    product = terms.join(template, "term").groupBy("unit", "unit_norm", "template", "licence", "norm", "n_must").agg(F.sum(F.col("u") * F.col("w")).alias("product"), F.sum("must").alias("musts"))
    cosine = F.round(F.col("product") / (F.col("unit_norm") * F.col("norm")), 6)
    near = product.where("musts >= n_must").select("unit", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least)
    best = near.groupBy("unit").agg(F.max("cosine").alias("cosine"), F.collect_list(F.struct("cosine", "licence")).alias("all"))
    ties = F.array_distinct(F.transform(F.filter("all", lambda a: a["cosine"] == F.col("cosine")), lambda a: a["licence"]))
    return best.select("unit", F.explode(ties).alias("licence"), "cosine")


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, to the root: structs of depth and name."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))


def scan_licences(files: DataFrame, templates=None, least: float = LEAST_COSINE, share: float = LEAST_SHARE) -> DataFrame:
    """For each of ``files(doc_id, path, text)``: doc_id, path, licence, cosine, n_mentions, origin, licensed_by.

    ``licence`` is the file's own (origin "own"): the one with the greatest
    cosine, then the one that most of its sentences name, then by name; else
    that of the nearest directory with a licence file ("inherited", ``licensed_by`` is
    the directory), else null ("none"). A licence file is one so named, or one
    of whose terms at least ``share`` are in sentences that name a licence, as
    lines or as paragraphs. A directory with several takes the greatest
    cosine, then the first name. ``templates`` are (licence, text, required
    term or None); those of ``licence_texts`` if None.

    Null and empty texts state nothing; a null path is in the root directory;
    texts of any length are compared whole. Repeated rows give a row each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = files.sparkSession
    rows = list(known_templates() if templates is None else templates)
    plain = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # Equal rows are one file; two hashes of 64 bits tell texts apart.
    identity = [F.col("doc_id"), F.col("path"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    with Scratch(spark, "licences") as scratch:
        frequencies = scratch.table(document_frequencies(plain), "frequencies")
        total = plain.count()
        vocabulary = sorted({t for _, body, _ in rows for t in _plain_terms(body)})
        counted = {r["term"]: r["df"] for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}
        idf = {t: math.log((total + 1.0) / (counted.get(t, 0) + 1.0)) + 1.0 for t in vocabulary}
        keys = F.array(*(F.lit(k) for k in key_terms(rows, idf, least)))
        terms = terms_of(text)

        levels = [(F.array(*(F.lit(t) for t in level)), most) for level, most in share_levels(rows, idf)]

        def reaches(s: Column) -> Column:
            own = terms_of(s)
            return reduce(add, (F.size(F.array_intersect(own, level)) * most for level, most in levels)) >= 0.999 * least * least

        def stated(sentences: Column) -> Column:
            some = F.filter(sentences, lambda s: F.arrays_overlap(terms_of(s), keys))
            return F.array_distinct(F.filter(some, reaches))

        some = plain.select(*identity, F.size(terms).alias("n_terms"), F.arrays_overlap(terms, keys).alias("states"), "text").where("states")
        kinds = F.array(F.struct(F.lit(True).alias("lines"), stated(line_sentences(text)).alias("bodies")), F.struct(F.lit(False).alias("lines"), stated(paragraph_sentences(text)).alias("bodies")))
        some = some.select("doc_id", "path", "h1", "h2", "n_terms", F.explode(kinds).alias("k")).select("doc_id", "path", "h1", "h2", "n_terms", "k.lines", F.explode("k.bodies").alias("body")).distinct()
        bodies = scratch.table(some.withColumn("unit", F.sha2("body", 256)), "sentences")
        near = scratch.table(nearest_templates(bodies.select("unit", "body").distinct(), frequencies, total, spark, _weights(rows, idf), least), "nearest")
        file = ["doc_id", "path", "h1", "h2"]
        matched = bodies.join(near.select("unit").distinct(), "unit")
        size = F.size(terms_of(F.col("body")))
        covered = matched.groupBy(*file, "n_terms").agg(F.countDistinct("unit").alias("n_mentions"), F.sum(F.when(F.col("lines"), size)).alias("in_lines"), F.sum(F.when(~F.col("lines"), size)).alias("in_paragraphs"))
        votes = bodies.select(*file, "unit").distinct().join(near, "unit").groupBy(*file, "licence").agg(F.count("*").alias("n"), F.max("cosine").alias("cosine"))
        own = votes.groupBy(*file).agg(F.min(F.struct((-F.col("cosine")).alias("c"), (-F.col("n")).alias("n"), "licence")).alias("b")).select(*file, F.col("b.licence").alias("own"), (-F.col("b.c")).alias("cosine"))
        enough = F.greatest(F.coalesce("in_lines", F.lit(0)), F.coalesce("in_paragraphs", F.lit(0))) >= F.lit(share) * F.col("n_terms")
        same = [own[c].eqNullSafe(covered[c]) for c in file]
        found = own.join(covered, same).select(*(own[c] for c in file), "own", "cosine", "n_mentions", (named_as_licence(own["path"]) | enough).alias("is_file"))
        found = materialise(found, "licences-own")
    holders = found.where("is_file").groupBy(parent(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("name"))).alias("h")).select("above", F.col("h.name").alias("held"))
    directories = plain.select(parent(F.col("path")).alias("directory")).distinct()
    chain = directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("a")).select("directory", "a.*")
    nearest = chain.join(holders, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "held")).alias("n")).select("directory", F.col("n.above").alias("licensed_by"), F.col("n.held").alias("inherited"))
    # A table of its own, so that its join may be split at directories with very many files.
    nearest = materialise(nearest, "licences-directories")
    every = plain.select(*identity).withColumn("directory", parent(F.col("path")))
    mine = found.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("h1").alias("a"), F.col("h2").alias("b"), "own", "cosine", "n_mentions")
    joined = every.join(mine, every["doc_id"].eqNullSafe(mine["d"]) & (every["path"] == mine["p"]) & (every["h1"] == mine["a"]) & (every["h2"] == mine["b"]), "left").join(nearest, "directory", "left")
    licence = F.coalesce("own", "inherited")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", licence.alias("licence"), "cosine", F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("licensed_by")).alias("licensed_by"))


def named_as_licence(path: Column) -> Column:
    """Whether a path's file name is that of a licence file."""
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(FILE_NAME)


def corpus_path(docs: DataFrame) -> Column:
    """A path for a document of a corpus without files: source, language, thousands, id."""
    parts = [F.coalesce(F.col("source"), F.lit("unknown")), F.coalesce(F.col("lang"), F.lit("unknown")), F.coalesce(F.floor(docs["doc_id"] / 1000).cast("string"), F.lit("none")), F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("none")), F.lit(".txt"))]
    return F.concat_ws("/", *parts)


def template_values() -> str:
    """The templates as SQL rows (template, licence, body, must)."""
    return ", ".join("({}, '{}', '{}', {})".format(i, licence, text.replace("'", "''"), f"'{must}'" if must else "NULL") for i, (licence, text, must) in enumerate(known_templates()))
