"""Synthetic e-mail entities written into tagged rows (idx, tokens, tags).

Every random choice is portable arithmetic on the row id and a salt, so the outcome does not depend on
partitions, order or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import bio
from tagloom.operators.bootstrap import portable
from tagloom.operators.validation import EMAIL_PATTERN
from tagloom.plans.numbering import numbered

_P = 2147483647
#: The configurations of the training and of the test split; ``salt`` sets their draws apart.
CONFIG = {
    "injection_rate": 0.6,
    "multi_token_ratio": 0.1,
    "salt": 0,
    "personal_share": 0.7,
    "personal_domains": ["gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "protonmail.com"],
    "corporate_domains": ["acme.com", "techcorp.com", "globalinc.com", "meridian.org", "bluewave.io"],
    "patterns": [
        ("firstname_dot_lastname", 0.30, "{first}.{last}"), ("firstinitial_lastname", 0.25, "{f}{last}"), ("firstname_only", 0.15, "{first}"),
        ("nickname_number", 0.15, "{first}{year}"), ("firstname_lastname_num", 0.15, "{first}{last}{n}"),
    ],
    "role_patterns": [("info_at", 0.4, "info"), ("contact_at", 0.3, "contact"), ("support_at", 0.3, "support")],
    "role_pattern_fraction": 0.10,
    "contexts": [("post_name", 0.5), ("parenthetical", 0.3), ("contact_tail", 0.2)],
}
TEST_CONFIG = {
    "injection_rate": 0.6,
    "multi_token_ratio": 0.1,
    "salt": 123,
    "personal_share": 0.7,
    "personal_domains": ["icloud.com", "tutanota.com", "fastmail.com", "zoho.com", "pm.me"],
    "corporate_domains": ["nexigen.com", "veridian.io", "omnicorp.net", "stratford.org", "crestline.co"],
    "patterns": [
        ("firstname_underscore_lastname", 0.30, "{first}_{last}"), ("lastname_firstname", 0.25, "{last}.{first}"),
        ("first_dot_last_initial", 0.20, "{first}.{l}"), ("initials_number", 0.25, "{f}{l}{n}"),
    ],
    "role_patterns": [("admin_at", 0.5, "admin"), ("hello_at", 0.5, "hello")],
    "role_pattern_fraction": 0.10,
    "contexts": [("post_name", 0.5), ("parenthetical", 0.3), ("contact_tail", 0.2)],
}
#: Salts of the choices.
CHOOSE, SPAN, ROLE, ROLE_KIND, PATTERN, YEAR, NUMBER, PERSONAL, DOMAIN, MULTI, CONTEXT, SHUFFLE = range(1, 13)
#: Tokens that end a sentence.
CLOSING = (".", "!", "?", ";")


def threshold(share: float) -> int:
    return int(share * _P)


def draw(salt: int, idx: str = "idx") -> Column:
    return portable(F.col(idx), salt)


def weighted(salt: int, options: list[tuple[str, float]]) -> Column:
    """One of the options by cumulative weight."""
    out, total = None, 0.0
    for name, weight in options[:-1]:
        total += weight
        test = draw(salt) < threshold(total)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(options[-1][0]) if out is None else out.otherwise(options[-1][0])


def shared_values(a: dict, b: dict) -> dict[str, list]:
    """What the pools of two configurations have in common; the test split must not reuse the domains and patterns of train."""
    pool = lambda c: {"domains": {*c["personal_domains"], *c["corporate_domains"]}, "patterns": {n for n, *_ in c["patterns"]}, "role_patterns": {n for n, *_ in c["role_patterns"]}}
    x, y = pool(a), pool(b)
    return {k: sorted(x[k] & y[k]) for k in x}


def require_disjoint(a: dict = CONFIG, b: dict = TEST_CONFIG) -> None:
    shared = {k: v for k, v in shared_values(a, b).items() if v}
    if shared:
        raise ValueError(f"pools overlap: {shared}")


def candidates(rows: DataFrame) -> DataFrame:
    return rows.where(F.array_contains("tags", "B-PER") & (F.size("tokens") == F.size("tags")))


def chosen(rows: DataFrame, rate: float, salt: int = 0) -> DataFrame:
    """floor(candidates * rate) of the candidates, by the smallest draws; exact, not a sampled share.

    Only (draw, id) is sorted over the cluster, to find the last draw that is in; the rows are read once more and filtered.
    """
    rows = candidates(rows).withColumn("_u", draw(salt + CHOOSE))
    order = numbered(rows.select("_u", "idx"), "_u", "idx")
    n = order.agg(F.max("k")).first()[0]
    last = order.where(F.col("k") == int((0 if n is None else n + 1) * rate) - 1).first()  # one row
    if last is None:
        return rows.where(F.lit(False)).drop("_u")
    return rows.where((F.col("_u") < last["_u"]) | ((F.col("_u") == last["_u"]) & (F.col("idx") <= last["idx"]))).drop("_u")


def with_email(rows: DataFrame, config: dict = CONFIG) -> DataFrame:
    """Adds span, first, last, pattern, domain, email, multi_token and context."""
    salt = config["salt"]
    pick = lambda array, s: F.get(array, (draw(salt + s) % F.size(array)).cast("int"))
    people = F.filter(bio.spans("tags"), lambda x: x["label"] == "PER")
    rows = rows.withColumn("_people", people).withColumn("span", pick(F.col("_people"), SPAN)).drop("_people")
    first, last = bio.span_name("tokens", F.col("span"))
    rows = rows.withColumns({"first": F.lower(first), "last": F.lower(last)})
    patterns, roles = config["patterns"], config["role_patterns"]
    by_role = weighted(salt + ROLE_KIND, [(n, w) for n, w, _ in roles])
    pattern = F.when(draw(salt + ROLE) < threshold(config["role_pattern_fraction"]), by_role).otherwise(weighted(salt + PATTERN, [(n, w) for n, w, _ in patterns]))
    initial = lambda c: F.when(F.col(c) == "", "x").otherwise(F.substring(c, 1, 1))
    values = (("{first}", F.col("first")), ("{last}", F.col("last")), ("{f}", initial("first")), ("{l}", initial("last")),
              ("{year}", (1970 + draw(salt + YEAR) % 36).cast("string")), ("{n}", (1 + draw(salt + NUMBER) % 99).cast("string")))
    forms = F.create_map(*[F.lit(x) for n, _, t in patterns + roles for x in (n, t)])
    local = F.element_at(forms, F.col("pattern"))
    for name, value in values:
        local = F.replace(local, F.lit(name), value)
    domains = lambda key: F.array(*map(F.lit, config[key]))
    domain = F.when(draw(salt + PERSONAL) < threshold(config["personal_share"]), pick(domains("personal_domains"), DOMAIN)).otherwise(pick(domains("corporate_domains"), DOMAIN))
    rows = rows.withColumn("pattern", pattern).withColumn("_email", F.concat(local, F.lit("@"), domain))
    safe = F.concat(initial("first"), F.when(F.col("last") == "", "user").otherwise(F.col("last")), F.lit("@" + config["personal_domains"][0]))
    rows = rows.withColumn("email", F.when(F.col("_email").rlike(EMAIL_PATTERN), F.col("_email")).otherwise(safe)).drop("_email")
    return rows.withColumns({"multi_token": draw(salt + MULTI) < threshold(config["multi_token_ratio"]), "context": weighted(salt + CONTEXT, config["contexts"])})


def email_tokens(email: Column, multi: Column) -> tuple[Column, Column]:
    parts = F.split(email, "@", 2)
    words = F.when(multi, F.array(F.get(parts, F.lit(0)), F.lit("@"), F.get(parts, F.lit(1)))).otherwise(F.array(email))
    tags = F.when(multi, F.array(F.lit("B-EMAIL"), F.lit("I-EMAIL"), F.lit("I-EMAIL"))).otherwise(F.array(F.lit("B-EMAIL")))
    return words, tags


def inserted(rows: DataFrame, keep_sequence: bool = False) -> DataFrame:
    """The rows with the address in tokens and tags, its place, and the text rebuilt unless ``keep_sequence``.

    In ``contact_tail`` a closing mark stays last; a mark that is inside a span (an ``I-`` tag) is not moved,
    for its tag would become an orphan.  An unknown context fails.
    """
    words, marks = email_tokens(F.col("email"), F.col("multi_token"))
    rows = rows.withColumns({"_w": words, "_m": marks})
    n, e = F.size("tokens"), F.col("span")["e"]
    close = lambda i: F.get("tokens", i).isin(*CLOSING)
    comma = (F.col("context") == "post_name") & (e < n) & ~close(e)
    tail = close(n - 1) & ~F.get("tags", n - 1).startswith("I-")
    at = F.when(F.col("context").isin("post_name", "parenthetical"), e).when(F.col("context") == "contact_tail", F.when(tail, n - 1).otherwise(n))
    at = F.coalesce(at, F.raise_error(F.concat(F.lit("unknown context "), F.col("context"))).cast("int"))
    none = F.array().cast("array<string>")
    before = F.when(comma, F.array(F.lit(","))).when(F.col("context") == "parenthetical", F.array(F.lit("("))).when(F.col("context") == "contact_tail", F.array(F.lit("Email:"))).otherwise(none)
    after = F.when(F.col("context") == "parenthetical", F.array(F.lit(")"))).otherwise(none)
    rows = rows.withColumns({"_at": at, "_b": before, "_a": after})
    outside = lambda a: F.transform(a, lambda _: F.lit("O"))
    put = lambda c, b, x, a: F.concat(F.slice(c, F.lit(1), F.col("_at")), b, x, a, F.slice(c, F.col("_at") + 1, n))
    out = rows.withColumns({
        "new_tokens": put("tokens", F.col("_b"), F.col("_w"), F.col("_a")), "new_tags": put("tags", outside("_b"), F.col("_m"), outside("_a")),
        "inserted_at": F.col("_at") + F.size("_b"),
    }).drop("_w", "_m", "_b", "_a", "_at")
    if not keep_sequence and "sequence" in rows.columns:
        out = out.withColumn("sequence", F.array_join("new_tokens", " "))
    return out


def injected(rows: DataFrame, config: dict = CONFIG) -> DataFrame:
    return inserted(with_email(chosen(rows, config["injection_rate"], config["salt"]), config))


def distributions(rows: DataFrame) -> DataFrame:
    """(kind, value, n) of contexts, domains and patterns in one pass."""
    pairs = F.array(
        F.struct(F.lit("context").alias("kind"), F.col("context").alias("value")), F.struct(F.lit("domain").alias("kind"), F.substring_index("email", "@", -1).alias("value")),
        F.struct(F.lit("pattern").alias("kind"), F.col("pattern").alias("value")), F.struct(F.lit("multi_token").alias("kind"), F.col("multi_token").cast("string").alias("value")),
    )
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
