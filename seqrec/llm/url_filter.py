"""URL filters: rules first, then a path-template tree per host.

A path's segments are generalised in two ways: a segment with a digit becomes its shape (digits, and
what else is not a file extension, as ``*``), and then, level by level from the root to the real depth, the children
of a node whose share of bad labels does not differ significantly from all its children's are merged into one
branch (``+``). In a node with over ``MAX_KIDS`` different children that branch is the wildcard (``*``), and it also
takes the children with under ``RARE`` labels; those that differ significantly keep their own. Every
template's purity (share of good labels) is smoothed towards its host's, and that towards the whole
table's. A template is rejected, with all its urls, if even the upper end of its purity's interval (``SURE`` standard
deviations above the smoothed share) is under ``MIN_PURITY``: more bad than good, beyond doubt.

``url_labels`` makes labels that concern urls: what the rules decide, and urls with a word of ``SEEDS`` in host or path.

The tree is built over distinct (host, shape) rows by keyed aggregations, so a hot host is summed before
it is shuffled; no node's urls meet in one task.

Defined cases: a null url, or one without ``://``, has empty host and path and belongs to the empty host;
repeated rows are each judged; unlabelled tables judge by the prior and allow; an empty table gives an
empty result; conflicting labels of an id count as bad; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm.words import UPPER
from seqrec.plans.lineage import materialize, small_side

MAX_KIDS = 20
MIN_PURITY = 0.5
SURE = 1.64
#: Words by which hosts and paths tell that they are unwanted.
SEEDS = ["adult", "ads", "bets", "betting", "casino", "escort", "malware", "phishing", "pills", "poker", "porn", "spam", "torrent", "viagra", "warez", "xxx"]
#: Labels that the smoothing adds at the parent's purity, and good and bad labels that the table's purity starts from.
STRENGTH, PRIOR_GOOD, PRIOR_BAD = 10.0, 9.0, 1.0
#: Labels under which a child of a wide node has no branch of its own: there the smoothing outweighs them.
RARE = 10
#: Two-proportion z value under which a branch counts as similar to its siblings.
SIMILAR_Z = 2.58


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)([^?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(text, "://([^/?#]*)([^?#]*)", 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are configuration, tried longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_labels(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", seeds: list[str] | None = None) -> DataFrame:
    """(id, bad) of the urls that tell themselves: a seed word makes them bad, else the longest rule that fits decides; others have no row."""
    host, path = url_parts(F.col(url_col))
    name = F.concat(host, F.translate(path, UPPER, UPPER.lower()))
    urls = pages.select(F.col(id_col).alias("id"), name.alias("name"), longest_rule(host, path, rules)[1].alias("verdict"))
    word = "(^|[^a-z])(" + "|".join(SEEDS if seeds is None else seeds) + ")([^a-z]|$)"
    bad = F.when(F.col("name").rlike(word), F.lit(True)).otherwise(F.col("verdict") == "block")
    return urls.select("id", bad.alias("bad")).where("bad IS NOT NULL AND id IS NOT NULL")


def shape(path: Column) -> Column:
    """Segments of a path, with the segments that hold a digit generalised; a slash at the end is not a segment."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.regexp_replace(s, "^.*?(\\.[A-Za-z]{1,5})?$", "*$1")).otherwise(s))


def template_tree(shapes: DataFrame, max_kids: int = MAX_KIDS, z: float = SIMILAR_Z) -> DataFrame:
    """(host, segs, labelled, bad) -> plus ``template``; one aggregation and join a level."""
    rows = shapes.withColumn("template", F.lit(""))
    levels = shapes.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(levels):
        at = rows.withColumn("seg", F.get("segs", F.lit(d)))
        kids = at.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        all_kids = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("l").alias("ls"), F.sum("b").alias("bs"))
        pool = F.expr("(bs + 1) / (ls + 2)")
        off = F.abs(F.expr("try_divide(b, l)") - pool) / F.sqrt(pool * (1 - pool) * F.expr("try_divide(1, l) + 1 / (ls + 2)"))
        wide, alike = F.col("kids") > max_kids, F.coalesce(off < z, F.lit(True))
        name = F.when(wide & (alike | (F.col("l") < RARE)), F.lit("*")).when(~wide & (F.col("kids") > 1) & alike, F.lit("+")).otherwise(F.col("seg"))
        names = kids.join(all_kids, ["host", "template"]).select("host", "template", "seg", name.alias("name"))
        moved = at.join(names, ["host", "template", "seg"], "left")
        rows = materialize(moved.select(*shapes.columns, F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template")), "tree")
    return rows


def template_purity(rows: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(host, template, purity, purity_most): smoothed towards the host, that towards all labels; the upper end of its interval."""
    leaf = rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = leaf.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    whole = hosts.agg(F.coalesce(F.sum("hl"), F.lit(0)).alias("tl"), F.coalesce(F.sum("hb"), F.lit(0)).alias("tb"))
    base = (F.col("tl") - F.col("tb") + PRIOR_GOOD) / (F.col("tl") + PRIOR_GOOD + PRIOR_BAD)
    hosts = hosts.crossJoin(F.broadcast(whole)).select("host", ((F.col("hl") - F.col("hb") + strength * base) / (F.col("hl") + strength)).alias("hp"))  # whole: one row
    purity = (F.col("l") - F.col("b") + strength * F.col("hp")) / (F.col("l") + strength)
    out = leaf.join(hosts, "host").select("host", "template", purity.alias("purity"), (F.col("l") + strength + 1).alias("_n"))
    return out.select("host", "template", "purity", (F.col("purity") + SURE * F.sqrt(F.col("purity") * (1 - F.col("purity")) / F.col("_n"))).alias("purity_most"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", min_purity: float = MIN_PURITY) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, purity, purity_most. ``labels`` is (id, bad)."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    marks = labels.select(F.col("id").alias("_l"), F.col("bad").cast("int").alias("bad")).where("_l IS NOT NULL AND bad IS NOT NULL").groupBy("_l").agg(F.max("bad").alias("bad"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    seen = urls.join(small_side(marks), urls["id"] == F.col("_l"), "left").select("id", "host", "path", name.alias("rule"), verdict.alias("_by_rule"), shape(F.col("path")).alias("segs"), "bad")
    seen = materialize(seen, "urls")
    shapes = seen.groupBy("host", "segs").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialize(template_tree(materialize(shapes, "shapes")), "tree")
    judged = tree.select("host", "segs", "template").join(template_purity(tree), ["host", "template"])
    out = seen.drop("bad").join(small_side(materialize(judged, "judged")), ["host", "segs"], "left")
    own = F.when(F.col("purity_most") < min_purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("_by_rule", own).alias("verdict"), "template", "purity", "purity_most")
