"""Completeness and publisher identity, and the gates before a full audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.exact import exact_text
from .technical import _details, _issues, _result, site_fetches

GUIDE_WORDS, GUIDES = 1200, 3


def _texts(fetches: DataFrame, exact: bool) -> DataFrame:
    read = exact_text("body") if exact else html.body_text
    own = site_fetches(fetches)
    return own.withColumns({f"{p}_text": read(F.coalesce(F.col(f"{p}.body"), F.lit(""))) for p in ("home", "about", "contact")})


def _listed(found: Column) -> Column:
    return F.array_join(found, ", ")


def complete(strict: bool = False) -> Column:
    """Homepage, about and contact: presence, unfinished phrases, stubs. Four issues FAIL, two are a high risk."""
    home, about, contact = (F.col(f"{p}.status") for p in ("home", "about", "contact"))
    phrases = {p: text.found_phrases(F.col(f"{p}_text"), text.PLACEHOLDERS, strict) for p in ("home", "about", "contact")}
    some = {p: F.size(x) > 0 for p, x in phrases.items()}
    about_stub = (about == 200) & (text.word_count(F.col("about_text")) < 100)
    no_mail = ~text.has_email(F.col("contact_text"))

    def state(code: Column, *good: tuple[Column, str]) -> Column:
        out = F.when(code == 404, "MISSING")
        inner = F.lit("OK")
        for when, name in reversed(good):
            inner = F.when(when, name).otherwise(inner)
        return out.when(code == 200, inner).otherwise(F.concat(F.lit("ERROR ("), F.coalesce(code.cast("string"), F.lit("None")), F.lit(")")))

    issues = _issues(
        F.when(some["home"], F.concat(F.lit("homepage has unfinished phrases: "), _listed(phrases["home"]))),
        F.when(about == 404, "about page missing").when(about_stub, "about page is a stub").when((about == 200) & some["about"], F.concat(F.lit("about page has unfinished phrases: "), _listed(phrases["about"]))),
        F.when(contact == 404, "contact page missing").when((contact == 200) & some["contact"], F.concat(F.lit("contact page has unfinished phrases: "), _listed(phrases["contact"]))).when((contact == 200) & no_mail, "contact page has no address"),
    )
    dead = F.coalesce(home, F.lit(0)) != 200
    n = F.size(issues)
    status = F.when(dead, "FAIL").when(n >= 4, "FAIL").when(n >= 2, "HIGH_RISK").when(some["home"], "WARNING").otherwise("OK")
    every = F.when(dead, F.array(F.concat(F.lit("homepage gives "), F.coalesce(home.cast("string"), F.lit("None"))))).otherwise(issues)
    details = _details(about_page=F.when(~dead, state(about, (about_stub, "STUB"))), contact_page=F.when(~dead, state(contact, (some["contact"], "PLACEHOLDER"), (no_mail, "NO_EMAIL"))))
    return _result("site_completeness", status, every, details)


def identity() -> Column:
    """A name and a way of contact on the about page are asked for; credentials only noted."""
    code, own = F.col("about.status"), F.col("about_text")
    name, contact, skill = text.has_name(own), text.any_phrase(own, text.CONTACT), text.any_phrase(own, text.CREDENTIALS)
    issues = _issues(F.when(~name, "no name of a person found"), F.when(~contact, "no way of contact visible"), F.when(~skill, "no credentials claimed"))
    good = F.coalesce(code == 200, F.lit(False))
    status = F.when(code == 404, "FAIL").when(~good, "ERROR").when(~name | ~contact, "HIGH_RISK").otherwise("OK")
    every = F.when(code == 404, F.array(F.lit("about page missing"))).when(~good, F.array(F.concat(F.lit("about page can't be read ("), F.coalesce(code.cast("string"), F.lit("None")), F.lit(")")))).otherwise(issues)
    details = _details(has_name=F.when(good & name, "true"), has_contact=F.when(good & contact, "true"), has_credentials=F.when(good, skill))
    return _result("publisher_identity", status, every, details)


def checks(fetches: DataFrame, strict: bool = False, exact: bool = False) -> DataFrame:
    """site, pos, check, status, issues, details: the two checks of every site."""
    own = _texts(fetches, exact)
    return own.select("site", F.posexplode(F.array(complete(strict), identity())).alias("pos", "c")).select("site", "pos", "c.*")


#: Links to a person's or a company's profile.
PROFILE = r"(?i)href=[\"']https?://([a-z]+\.)?(linkedin\.com|github\.com|twitter\.com|x\.com)/"


def trust(fetches: DataFrame, exact: bool = False) -> DataFrame:
    """site, contact, profile: whether the about or the contact page names a way of contact, and the about page links
    to a profile. Null where neither says so and a page wasn't fetched."""
    own = _texts(fetches, exact)
    about, contact = (F.coalesce(F.col(f"{p}.status"), F.lit(0)) for p in ("about", "contact"))
    named = ((about == 200) & text.any_phrase(F.col("about_text"), text.CONTACT)) | ((contact == 200) & (text.has_email(F.col("contact_text")) | text.any_phrase(F.col("contact_text"), text.CONTACT)))
    known = about.isin(200, 404) & contact.isin(200, 404)
    linked = F.rlike(F.coalesce("about.body", F.lit("")), F.lit(PROFILE))
    return own.select("site", F.when(named, True).when(known, False).alias("contact"), F.when(about == 200, linked).alias("profile"))


def summary(found: DataFrame) -> DataFrame:
    fails, high = F.count_if(F.col("status").isin("FAIL", "ERROR")), F.count_if(F.col("status") == "HIGH_RISK")
    message = F.when(fails > 0, F.concat(fails.cast("string"), F.lit(" failed"))).when(high > 0, F.concat(high.cast("string"), F.lit(" at high risk"))).otherwise("all passed")
    return found.groupBy("site").agg(fails.alias("failures"), high.alias("high_risks"), message.alias("message"))


def guides(depth: DataFrame, least: int = GUIDE_WORDS) -> DataFrame:
    """site, guides: pages with the words of a guide."""
    return depth.groupBy("site").agg(F.count_if(F.col("word_count") >= least).alias("guides"))


def gates(found: DataFrame, guide_counts: DataFrame) -> DataFrame:
    """site, the three gates, blockers and the decision before a full audit."""
    n = F.size("issues")
    complete_n, identity_n = (F.max(F.when(F.col("check") == c, n)) for c in ("site_completeness", "publisher_identity"))
    own = found.groupBy("site").agg(F.coalesce(complete_n, F.lit(0)).alias("completeness_issues"), F.coalesce(identity_n, F.lit(0)).alias("identity_issues"))
    own = own.join(guide_counts, "site", "left").na.fill(0, ["guides"])
    first = F.when(F.col("completeness_issues") >= 4, "Blocker").when(F.col("completeness_issues") >= 2, "High Risk").otherwise("Pass")
    second = F.when(F.col("identity_issues") >= 1, "Blocker").otherwise("Pass")
    third = F.when(F.col("guides") < GUIDES, "High Risk").otherwise("Pass")
    out = own.withColumns({"completeness_gate": first, "identity_gate": second, "content_gate": third})
    # each issue is a blocker of its own once its gate blocks
    blockers = F.when(F.col("completeness_gate") == "Blocker", F.col("completeness_issues")).otherwise(0) + F.when(F.col("identity_gate") == "Blocker", F.col("identity_issues")).otherwise(0)
    decision = F.when(F.col("blockers") == 0, "full audit").when(F.col("blockers") <= 2, "fix structure first").otherwise("appears unfinished")
    return out.withColumn("blockers", blockers.cast("int")).withColumn("preflight", decision)
