"""URL filter by association rules, with DataFrame and SQL functions only.

Listed rules (host and path prefix) decide first; the longest that fits wins. Every other url is judged by rules that
are mined from labelled urls with Spark's FP-growth. Labels are the listed rules' own verdicts, and the quality of the
document whose number ends the path; that such a number names a document is an assumption about the tables.

1. Baskets hold the tokens of labelled urls and their class. A token or rule must occur in LEAST_BASKETS baskets and
   in the share MIN_SUPPORT of them. A token that all its baskets of one class hold is a rule by itself, which prunes every
   larger one, so FP-growth gets the other frequent tokens: of each basket the MOST_ITEMS rarest, as Spark's has no bound on
   the size of a set and a long url would give 2^length of them. Sets that end, from rare to frequent, in a token beyond
   these in any basket are grown as in its conditional trees, from that token by rarer ones, up to MOST_NEEDS tokens, as
   long as they are frequent and not of one class only. Both together find every frequent set that a rule can have.
2. Sets of up to MOST_NEEDS tokens are candidates. Support and confidence of what FP-growth found are counted again over all
   tokens of all baskets, through an inverted index that files each candidate under its rarest token. Equal baskets count
   at once.
3. A rule `tokens -> class` needs the least support, MIN_CONFIDENCE, and MIN_LIFT times the share of its class among all
   baskets (at most 1), so that no rule says just what most urls are; it is pruned if one with fewer of its tokens and
   the same class is as confident.
4. The same index finds the rules of a url; of those whose tokens the url all has, the most confident decides (then
   larger support, then `block`, then the tokens in order), and where none fits the url is allowed. Urls with equal
   tokens are matched once.

Cases: a null url or one without `://` has an empty host and path and is allowed; repeated rows are judged each;
without labels nothing is mined and only listed rules block; an empty table gives no rows; columns of clashing names
don't matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: (verdict, host, path). These values are fixed by the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
COPIES = 4096
LEAST_BASKETS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MOST_ITEMS, MOST_NEEDS = 10, 0.002, 0.75, 1.05, 10, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(n, rule, verdict) of the longest listed rule that fits, else null. Looks up the host's suffixes."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((verdict, p))
    entry = lambda h, v, p: F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    index = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[entry(h, v, p) for v, p in own]))])
    labels = F.split(host, r"\.")
    most = max(h.count(".") + 1 for h in by_host)
    ends = [F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")) for k in range(1, most + 1)]
    found = F.flatten(F.filter(F.transform(F.array(*ends), lambda end: F.try_element_at(index, F.coalesce(end, F.lit("")))), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda x: F.startswith(path, x["path"])))
    return F.when(best.isNotNull(), F.struct(best["n"].alias("n"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path words with digits as #, query keys, whether there is a fragment."""
    plain = lambda c: F.regexp_replace(c, r"\d+", "#")
    mark = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    hosts = mark("h:", F.split(host, r"\."))
    return F.array_sort(F.array_distinct(F.coalesce(F.concat(hosts, mark("p:", F.split(plain(path), r"[/._-]+")), mark("q:", keys)), F.array().cast("array<string>"))))


def parts(pages: DataFrame, rules=RULES) -> DataFrame:
    rows = pick(pages, page_id="page_id", url="url")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.select("page_id", "url", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def baskets_of(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, verdict of the labelled urls. Only urls with a number and without a listed rule meet the labels."""
    marks = pick(labels, doc="doc_id", quality="quality").where("doc is not null and quality in (0, 1)").groupBy("doc").agg(F.min("quality").alias("quality"))
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS bigint)")
    urls = urls.where("size(tokens) > 0")
    ruled = urls.where("listed is not null").select("tokens", F.col("listed.verdict").alias("verdict"))
    numbered = urls.where("listed is null").select("tokens", number.alias("doc")).where("doc is not null")
    # marks are written first, so that the join can split a number that many urls end with
    known = numbered.join(stored(marks), "doc").select("tokens", F.when(F.col("quality") == 1, "allow").otherwise("block").alias("verdict"))
    return ruled.unionByName(known)


def index_of(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of sets (needs, ...) with the rarest token of each, under which it is filed."""
    spread = sets.select("needs", F.explode("needs").alias("token")).join(counts.select("token", "n"), "token")
    return sets.join(spread.groupBy("needs").agg(F.min_by("token", F.struct("n", "token")).alias("token")), "needs")


def grown(paths: DataFrame, *, least: int, most_items: int, most_needs: int) -> list[DataFrame]:
    """needs, token (the first), verdict, support: a frame for each size from 2, of all frequent sets whose last token lies beyond the first most_items of a path (path, verdict, times).

    Sets are counted over all paths, at every size, and one of a single class is not grown further.
    """
    beyond = stored(paths.where(F.size("path") > most_items).select(F.explode(F.slice("path", F.lit(most_items + 1), F.size("path"))).alias("token")).distinct())
    if beyond.isEmpty():
        return []
    held = paths.select("verdict", "times", "path", F.posexplode("path").alias("at", "token")).join(beyond, "token", "left_semi")
    held, found = held.select("verdict", "times", F.slice("path", F.lit(1), F.col("at")).alias("path"), F.array("token").alias("needs")), []
    for _ in range(most_needs - 1):
        held = held.select("verdict", "times", "path", "needs", F.posexplode("path").alias("at", "token"))
        held = held.select("verdict", "times", F.slice("path", F.lit(1), F.col("at")).alias("path"), F.concat(F.array("token"), "needs").alias("needs"))
        sums = held.groupBy("needs", "verdict").agg(F.sum("times").alias("support")).groupBy("needs").agg(F.max("support").alias("most"), F.collect_list(F.struct("verdict", "support")).alias("classes"))  # two classes
        found.append(stored(sums.where(F.col("most") >= least)))
        held = held.join(found[-1].where(F.size("classes") > 1).select("needs"), "needs", "left_semi")
    return [x.select("needs", F.element_at("needs", 1).alias("token"), F.inline("classes")).withColumn("needs", F.array_sort("needs")) for x in found]


def mine(baskets: DataFrame, *, least_baskets: int = LEAST_BASKETS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, most_items: int = MOST_ITEMS, most_needs: int = MOST_NEEDS) -> DataFrame:
    """needs, verdict, confidence, support (baskets), token (the index key): rules from baskets (tokens, verdict)."""
    baskets = stored(baskets.groupBy("tokens", "verdict").agg(F.count("*").alias("times")).withColumn("basket", F.monotonically_increasing_id()))
    sizes = {r["verdict"]: r["n"] for r in baskets.groupBy("verdict").agg(F.sum("times").alias("n")).collect()}  # two classes
    total = sum(sizes.values())
    least = max(least_baskets, -int(-min_support * total // 1))
    spread = baskets.select("basket", "verdict", "times", F.explode("tokens").alias("token"))
    counts = stored(spread.groupBy("token").agg(F.sum("times").alias("n"), (F.min("verdict") < F.max("verdict")).alias("mixed")).where(F.col("n") >= least))
    path = F.array_sort(F.collect_list(F.struct("n", "token")))["token"]
    paths = stored(spread.join(counts.where("mixed"), "token").groupBy("basket", "verdict", "times").agg(path.alias("path")))
    # FP-growth takes no weights: a row for each of equal baskets, by pieces that go to different tasks
    pieces = paths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES).cast("int")))).repartition("basket", "piece")
    copies = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("times") - F.col("piece") * COPIES).cast("int")))
    items = stored(pieces.select(F.concat(F.slice("path", 1, most_items), F.array(F.concat(F.lit("="), "verdict"))).alias("items"), copies.alias("copy")).select("items"))
    share = min(1.0, (least - 0.5) / max(1, items.count()))
    found = FPGrowth(itemsCol="items", minSupport=share).fit(items).freqItemsets
    labelled = F.exists("items", lambda x: F.startswith(x, F.lit("=")))
    sets = found.where(labelled).select(F.filter("items", lambda x: ~F.startswith(x, F.lit("="))).alias("needs")).where(F.size("needs").between(1, most_needs))
    sets = sets.unionByName(counts.select(F.array("token").alias("needs"))).select(F.array_sort("needs").alias("needs")).distinct()
    counted = grown(paths, least=least, most_items=most_items, most_needs=most_needs)
    for own in counted:
        sets = sets.join(own.select("needs"), "needs", "left_anti")
    index = stored(index_of(sets, counts))
    held = baskets.select("tokens", "verdict", "times", F.explode("tokens").alias("token")).join(index, "token")
    held = held.where(F.size(F.array_except("needs", "tokens")) == 0).groupBy("needs", "token", "verdict").agg(F.sum("times").alias("support"))
    for own in counted:
        held = held.unionByName(own)
    of = held.groupBy("needs").agg(F.sum("support").alias("of"))
    lifted = lambda verdict: F.lit(min(1.0, min_lift * sizes.get(verdict, 0) / max(1, total)))
    surest = F.greatest(F.lit(min_confidence), F.when(F.col("verdict") == "block", lifted("block")).otherwise(lifted("allow")))
    rules = stored(held.join(of, "needs").withColumn("confidence", F.col("support") / F.col("of")).where((F.col("support") >= least) & (F.col("confidence") >= surest)).drop("of"))
    # a rule is pruned if one with fewer of its tokens says the same as surely; a rule has at most 2^most_needs - 2 such
    one = [F.transform("needs", lambda x: F.array(x))]
    for _ in range(most_needs - 2):
        one.append(F.flatten(F.transform(one[-1], lambda own: F.transform(F.filter("needs", lambda x: x > F.element_at(own, -1)), lambda x: F.concat(own, F.array(x))))))
    parts = rules.where(F.size("needs") > 1).select(F.col("needs").alias("whole"), "verdict", F.col("confidence").alias("own"), F.explode(F.filter(F.flatten(F.array(*one)), lambda x: F.size(x) < F.size("needs"))).alias("needs"))
    pruned = parts.join(rules, ["needs", "verdict"]).where("confidence >= own").select(F.col("whole").alias("needs"), "verdict").distinct()
    return rules.join(pruned, ["needs", "verdict"], "left_anti").select("needs", "verdict", "confidence", "support", "token")


def match(signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, method for each distinct token set that a mined rule fits."""
    hits = signatures.select("tokens", F.explode("tokens").alias("token")).join(rules, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    rank = F.struct(-F.col("confidence"), -F.col("support"), F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("needs"))
    return hits.groupBy("tokens").agg(F.min_by("verdict", rank).alias("method"))


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    urls = parts(pages, rules)
    matched = match(urls.where("listed is null").select("tokens").distinct(), stored(mine(baskets_of(urls, labels), **options)))
    # matches are written first, so that the join can split a frequent set of tokens
    return urls.join(stored(matched), "tokens", "left").select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "method", F.lit("allow")).alias("verdict"))


def listed_only(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, listed: what the listed rules alone say."""
    return parts(pages, rules).select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("listed"))
