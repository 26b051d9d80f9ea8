"""Personal data: exact base patterns, and further spans by weak supervision.

Columns only. A pattern's matches are the strings between the pieces of a split, so a span's place is
the running length of pieces and matches before it; texts never move, only matches with a few
characters around them. Base kinds are email, ip, card and phone, with their checks. Further
candidates are values behind words such as password or token, phone numbers without a plus, numbers
of identity papers and accounts (runs of 16 to 19 digits that fail the card's check among them), and
long mixed strings.

Labelers vote on every candidate, base matches that failed their check included: strict patterns, a
gazetteer of words before a span, gazetteers of domains, networks and card issuers, the signs before
it, its shape, and what stands around it. Expectation-maximisation over the counts of vote patterns
(at most 3 ** 6, whatever the input's size) estimates the labelers' reliabilities without labels. Its
posteriors train the final classifier, naive Bayes over the span's features, which judges all
candidates; those that it takes and that overlap no base span are added. Of overlapping candidates the
more specific kind stays.

Null and empty texts have no spans. Repeated rows get the same result each; with several texts
under an id each row has its own. An empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasforge.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no start inside a run is tried twice.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "keyed": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|passwort|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}",
    "local": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "paper": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
}
#: What a text must contain for a pattern to match at all.
_NEEDS = {"email": "@", "phone": "+", "keyed": None}
#: By kind: the name in the result, and which of overlapping candidates stays.
ADDED = {"keyed": ("secret", 1), "local": ("phone", 2), "paper": ("identity", 3), "account": ("account", 4), "mixed": ("secret", 5)}
_ORDER = [*KINDS, "secret", "identity", "account"]
AROUND = 32


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    at = lambda k: F.substring(back, k + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, k: a + F.when(k % 2 == 1, at(k) * 2 - F.when(at(k) > 4, 9).otherwise(0)).otherwise(at(k)))
    return total % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    digits = _digits(hit)
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    card = F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.length(digits).between(8, 15)).otherwise(False)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, kind, k, start, end, hit, before, after, valid) for every match of every pattern."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").rlike("[0-9@+=:]"))
    for kind, pattern in PATTERNS.items():
        sign = _NEEDS.get(kind, "[0-9]")
        may = F.col("text").contains(sign) if sign in ("@", "+") else F.col("text").rlike(sign or "[=:]")
        base = base.withColumn(f"g_{kind}", F.when(may, F.split("text", pattern, -1)).otherwise(F.array(F.lit(""))))
        base = base.withColumn(f"h_{kind}", F.when(F.size(f"g_{kind}") > 1, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def rows(kind: str) -> Column:
        gaps = F.col(f"g_{kind}")
        before = lambda k: F.get(gaps, k)
        return F.transform(f"h_{kind}", lambda h, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(before(k)).alias("gap"), h.alias("hit"), F.right(before(k), F.lit(AROUND)).alias("before"), F.left(before(k + 1), F.lit(AROUND)).alias("after")))

    found = base.select("doc_id", "text_hash", F.explode_outer(F.concat(*map(rows, PATTERNS))).alias("m")).where("m is not null").select("doc_id", "text_hash", "m.*")
    found = found.dropDuplicates(["doc_id", "text_hash", "kind", "k"])  # of repeated rows
    run = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.length("hit")).over(run)
    found = found.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("hit"))
    value = F.regexp_extract("hit", r"[=:]\s*[\"']?([^\s\"',;]+)$", 1)
    keyed = F.col("kind") == "keyed"
    found = found.withColumn("key", F.when(keyed, F.regexp_extract("hit", "^[A-Za-z_-]+", 0)).otherwise("")).withColumn("before", F.when(keyed, F.concat("before", F.substring("hit", F.lit(1), F.length("hit") - F.length(value)))).otherwise(F.col("before")))
    found = found.withColumn("hit", F.when(keyed, value).otherwise(F.col("hit"))).withColumn("start", F.col("end") - F.length("hit"))
    found = found.withColumn("valid", valid(F.col("kind"), F.col("hit"))).drop("gap")
    account = (F.col("kind") == "card") & ~F.col("valid") & F.length(_digits(F.col("hit"))).between(16, 19)
    return found.withColumn("kind", F.when(account, "account").otherwise(F.col("kind")))


#: Gazetteers.
WORDS_BEFORE = "password|passwd|pwd|passwort|token|secret|key|mail|contact|phone|call|tel|mobile|fax|card|visa|account|iban|ssn|login|user|address"
DOMAINS = "com|org|net|edu|gov|info|io|co|uk|us|de|fr|es|it|nl|eu|ch|at|be|pl|ru|jp|cn|in|br|ca|au"
LABELERS = ("strict", "words", "lists", "signs", "shape", "around")


def votes() -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 personal, 0 not, -1 none."""
    kind, hit, before, after = (F.col(c) for c in ("kind", "hit", "before", "after"))
    is_base = kind.isin(*KINDS)
    digits, size = F.length(_digits(hit)), F.length(hit)
    domain = F.regexp_extract(hit, r"\.([A-Za-z0-9-]+)$", 1)
    private = hit.rlike(r"^(0|10|127|255)\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^169\.254\.")
    return {
        "strict": F.when(is_base, F.col("valid").cast("int")).otherwise(-1),
        "words": F.when(F.lower(before).rlike(rf"(?<![a-z])({WORDS_BEFORE})s?[^a-z]*$"), 1).otherwise(-1),
        "lists": F.when(kind == "email", F.lower(domain).rlike(f"^({DOMAINS})$").cast("int")).when(kind == "ip", F.when(private, 0).otherwise(1)).when(kind == "card", hit.rlike("^[3-6]").cast("int")).otherwise(-1),
        "signs": F.when(before.rlike(r"[=:\"'(<\[]\s*$"), 1).when(before.rlike(r"[A-Za-z0-9]$"), 0).otherwise(-1),
        "shape": F.when((digits * 4 >= size) & (size >= 8), 1).when(digits == 0, 0).otherwise(-1),
        "around": F.when(after.rlike(r"^[A-Za-z0-9]"), 0).when(after.rlike(r"^([\s\"'.,;:!?)\]]|$)"), 1).otherwise(-1),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], float, dict[tuple[int, ...], float]]:
    """Expectation-maximisation: each labeler's reliability, the share of personal data, and the
    posterior of each pattern of votes."""
    right, share = [0.8] * len(LABELERS), 0.5
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes_, _ in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for v, r in zip(votes_, right, strict=True):
                if v >= 0:
                    yes += math.log(r if v else 1 - r)
                    no += math.log(1 - r if v else r)
            post[votes_] = 1 / (1 + math.exp(min(700, no - yes)))
        total = sum(n for _, n in patterns)
        share = min(0.95, max(0.05, sum(post[v] * n for v, n in patterns) / max(total, 1)))
        for k in range(len(right)):
            cast = [(v, n) for v, n in patterns if v[k] >= 0]
            agree = sum(n * (post[v] if v[k] else 1 - post[v]) for v, n in cast)
            right[k] = min(0.99, max(0.51, (agree + 8) / (sum(n for _, n in cast) + 10)))
    return right, share, post


def span_features() -> dict[str, Column]:
    """What the final classifier sees of a candidate, few values each."""
    hit = F.col("hit")
    size = F.greatest(F.length(hit), F.lit(1))
    return {
        "kind": F.concat(F.col("kind"), F.when(F.col("kind").isin(*KINDS), F.when(F.col("valid"), "+").otherwise("-")).otherwise("")),
        "length": F.least(F.floor(F.log2(size)), F.lit(7)).cast("string"),
        "digits": F.floor(F.length(_digits(hit)) * 4 / size).cast("string"),
        "upper": F.least(F.length(F.regexp_replace(hit, "[^A-Z]", "")), F.lit(2)).cast("string"),
        "previous": F.when(F.col("before") == "", "start").when(F.col("before").rlike(r"\s$"), "space").when(F.col("before").rlike("[A-Za-z0-9]$"), "word").otherwise("sign"),
        "next": F.when(F.col("after") == "", "end").when(F.col("after").rlike(r"^\s"), "space").when(F.col("after").rlike("^[A-Za-z0-9]"), "word").otherwise("sign"),
        "key": (F.col("key") != "").cast("string"),
    }


def classified(found: DataFrame) -> DataFrame:
    """The candidates with `probability`, by the classifier that the votes have trained."""
    voted = found.withColumns({f"v_{k}": c for k, c in votes().items()})
    names = [f"v_{k}" for k in LABELERS]
    counted = [(tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    _, _, post = estimate(counted)
    soft = F.lit(0.5)
    if post:
        table = F.create_map(*(F.lit(x) for v, p in post.items() for x in (",".join(map(str, v)), p)))
        soft = table[F.concat_ws(",", *names)]
    marked = voted.withColumn("q", soft).withColumns({f"f_{k}": c for k, c in span_features().items()})
    pairs = F.explode(F.array(*(F.concat(F.lit(f"{k}="), F.col(f"f_{k}")) for k in span_features())))
    sums = {r["f"]: (r["yes"], r["no"]) for r in marked.select(pairs.alias("f"), "q").groupBy("f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()}
    yes = sum(y for f, (y, _) in sums.items() if f.startswith("kind="))
    no = sum(n for f, (_, n) in sums.items() if f.startswith("kind="))
    score = F.lit(math.log((yes + 1) / (no + 1)))
    if sums:
        weights = F.create_map(*(F.lit(x) for f, (y, n) in sums.items() for x in (f, math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2)))))
        for k in span_features():
            score = score + F.coalesce(weights[F.concat(F.lit(f"{k}="), F.col(f"f_{k}"))], F.lit(0.0))
    return marked.withColumn("probability", 1 / (1 + F.exp(-score))).drop(*names, "q", *(f"f_{k}" for k in span_features()))


def find(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, start, end, base, probability): all base spans and those added."""
    # short runs of digits that no check takes are no candidates
    worth = F.col("valid") | ~F.col("kind").isin("card") | (F.length(_digits(F.col("hit"))) >= 7)
    found = staged(candidates(docs, id_col, text_col).where(worth), "pii-candidates")
    judged = classified(found)
    is_base = F.col("kind").isin(*KINDS)
    kept = judged.where(F.when(is_base, F.col("valid")).otherwise(F.col("probability") >= threshold))
    rank = F.lit(0)
    name = F.col("kind")
    for kind, (shown, place) in ADDED.items():
        rank, name = F.when(F.col("kind") == kind, place).otherwise(rank), F.when(F.col("kind") == kind, shown).otherwise(name)
    kept = kept.withColumn("rank", rank)
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "rank", "end")
    so_far, later = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    free = F.lit(True)
    for p in range(1, max(r for _, r in ADDED.values()) + 1):
        ends = F.max(F.when(F.col("rank") < p, F.col("end"))).over(so_far)
        begins = F.min(F.when(F.col("rank") < p, F.col("start"))).over(later)
        clear = (F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
        free = F.when(F.col("rank") == p, clear).otherwise(free)
    return kept.withColumn("free", free).where("free").select("doc_id", "text_hash", name.alias("kind"), "start", "end", (F.col("rank") == 0).alias("base"), "probability")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans (all
    spans), and of those added n_secret, n_identity, n_account and n_added_phone."""
    place = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("kind"))
    found = find(docs, id_col=id_col, text_col=text_col).withColumn("s", F.struct(place.alias("p"), "start", "end", "kind"))
    counts = [F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS]
    more = {"n_spans": F.lit(True), "n_secret": F.col("kind") == "secret", "n_identity": F.col("kind") == "identity", "n_account": F.col("kind") == "account", "n_added_phone": ~F.col("base") & (F.col("kind") == "phone")}
    counts += [F.sum(test.cast("long")).alias(k) for k, test in more.items()]
    listed = found.groupBy("doc_id", "text_hash").agg(*counts, F.array_sort(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("b"), F.array_sort(F.collect_list("s")).alias("a"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    listed = listed.select("doc_id", "text_hash", *(f"n_{k}" for k in KINDS), *more, shown("b").alias("base"), shown("a").alias("spans"), (F.size("a") - F.size("b")).cast("long").alias("n_added"))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    joined = keys.alias("l").join(listed.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")), "left")
    zero = [F.coalesce(F.col(f"r.n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return joined.select("l.doc_id", *zero, F.sha2(F.coalesce("r.base", F.lit("")), 256).alias("base_sha256"), F.coalesce("r.spans", F.lit("")).alias("spans"), *(F.coalesce(f"r.{k}", F.lit(0)).cast("long").alias(k) for k in ("n_added", *more)))
