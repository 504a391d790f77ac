"""The audit's dimensions: requirements, rubric checks, rejection reasons. Topics are in our own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: section, id, severity, where the evidence comes from, topic
_REQUIREMENTS = """
A ADS-ELIG-01 Blocker manual applicant age and eligibility
A ADS-ELIG-02 Blocker manual no second account for one publisher
A ADS-ELIG-03 Blocker derived content obeys program and publisher policies
A ADS-ELIG-04 Medium manual hosted products use another flow
B ADS-OWN-01 Blocker manual control of page source and head
B ADS-OWN-02 Blocker manual verifiable ownership
B ADS-OWN-03 High manual scripts and normal rendering work
B ADS-SITE-01 Blocker manual site listed, verified, reviewed, ready
B ADS-SITE-02 High manual a verification method is deployable
B ADS-TXT-01 High technical ads.txt lists the right seller
B ADS-TXT-02 Medium technical ads.txt is published
C ADS-CONTENT-01 Blocker depth useful original content
C ADS-CONTENT-02 Blocker duplicates no copied content without own value
C ADS-CONTENT-03 High depth substantial main content
C ADS-CONTENT-04 High depth not empty or unfinished
C ADS-CONTENT-05 High manual ads do not dominate
C ADS-CONTENT-06 Medium manual supported main language
C ADS-CONTENT-07 Medium manual moderated user content
C ADS-CONTENT-08 Medium duplicates no doorway or keyword pages
D ADS-UX-01 High manual working readable navigation
D ADS-UX-02 High manual understandable structure
D ADS-UX-03 Blocker manual no deceptive navigation
D ADS-UX-04 Blocker manual no forced redirects, downloads, popups
D ADS-UX-05 Medium completeness trust pages exist
D ADS-UX-06 Medium manual ads separable from content
E ADS-CRAWL-01 Blocker crawl live; key URLs not 404/5xx
E ADS-CRAWL-02 Blocker technical crawler not blocked
E ADS-CRAWL-03 High manual no POST-only pages
E ADS-CRAWL-04 High technical few redirects
E ADS-CRAWL-05 Medium crawl stable URLs
E ADS-CRAWL-06 High technical DNS and hosting respond
E ADS-CRAWL-07 Medium technical sitemap and stable index
F ADS-PROG-01 Blocker manual no self-clicks or inflation
F ADS-PROG-02 Blocker manual no asking for ad clicks
F ADS-PROG-03 Blocker manual ads clearly distinguishable
F ADS-PROG-04 High manual legitimate traffic
F ADS-PROG-05 High manual ad code unmodified in harmful ways
F ADS-PROG-06 Blocker manual no forbidden placements
F ADS-PROG-07 High manual WebView rules
G ADS-PUB-01 Blocker manual illegal content
G ADS-PUB-02 Blocker manual copyright, counterfeit
G ADS-PUB-03 Blocker manual dangerous or derogatory
G ADS-PUB-04 Blocker manual animal cruelty, endangered species
G ADS-PUB-05 Blocker manual misleading representation
G ADS-PUB-06 Blocker manual deceptive behaviour
G ADS-PUB-07 Blocker manual enabling dishonesty
G ADS-PUB-08 Blocker manual sexual services, family-content abuse
G ADS-PUB-09 Blocker technical accurate publisher data
G ADS-PUB-10 Blocker manual ads do not interfere
G ADS-PUB-11 Blocker depth no ads on low-value screens
G ADS-PUB-12 Blocker manual ads in context
G ADS-PUB-13 Blocker manual false harmful claims
G ADS-PUB-14 Blocker manual manipulated media
G ADS-PUB-15 Blocker manual child endangerment
G ADS-PUB-16 Blocker manual sensitive events
H ADS-REST-01 High manual sexual content
H ADS-REST-02 High manual shocking content
H ADS-REST-03 High manual weapons, explosives
H ADS-REST-04 High manual tobacco, drugs
H ADS-REST-05 High manual alcohol sale or misuse
H ADS-REST-06 High manual gambling
H ADS-REST-07 High manual prescription drugs, supplements
H ADS-REST-08 High manual ad obstruction
I ADS-PRIV-01 Blocker crawl privacy policy exists and discloses
I ADS-PRIV-02 High manual third-party cookie disclosure
I ADS-PRIV-03 High crawl no personal data in ad requests
I ADS-PRIV-04 High manual EU consent
I ADS-PRIV-05 High manual precise location disclosure
I ADS-PRIV-06 High manual child-directed marking
I ADS-PRIV-07 High manual no tampering with Google cookies
I ADS-PRIV-08 High manual no sensitive targeting
I ADS-PRIV-09 High manual housing, jobs, credit targeting
I ADS-PRIV-10 Medium manual personalized-ad rights and controls
J ADS-COMPLETE-01 Blocker completeness site not unfinished
J ADS-COMPLETE-02 High depth three substantive guides
K ADS-AUTHOR-01 Blocker completeness verifiable publisher
K ADS-AUTHOR-02 High completeness contact method
K ADS-AUTHOR-03 Medium completeness professional profile link
L ADS-CONTENT-ORIGINAL High manual distinct value of each tool
L ADS-CONTENT-ADDED-VALUE High manual guides add own work
L ADS-CONTENT-OVERLAP High overlap overlap with competitors
"""

#: rubric, check id, area, whether it can be computed, what it asks for
_RUBRICS = """
tool TOOL-01 content manual explains the tool
tool TOOL-02 content computed 300+ words
tool TOOL-03 content manual own guidance
tool TOOL-04 content manual useful without the tool
tool TOOL-05 content manual works without login
tool TOOL-06 content computed links 1–3 related tools
tool TOOL-07 content manual FAQ or help
tool TOOL-08 ads manual above-fold ratio
tool TOOL-09 ads manual ad labels
tool TOOL-10 ads manual tool-to-ad distance
tool TOOL-11 seo computed stable canonical URL
tool TOOL-12 seo computed description 100–160 chars
tool TOOL-13 seo computed descriptive title and H1
quiz QUIZ-01 content computed topic not a reused template
quiz QUIZ-02 content computed 80%+ own questions
quiz QUIZ-03 content manual 10+ questions
quiz QUIZ-04 content computed results unique, 200+ words
quiz QUIZ-05 content manual result value
quiz QUIZ-06 content manual intro exists
quiz QUIZ-07 site computed homepage value
quiz QUIZ-08 site manual meaningful categories
quiz QUIZ-09 site computed category text 200+ words
quiz QUIZ-10 site manual an editorial page
quiz QUIZ-11 ads manual above-fold ratio
quiz QUIZ-12 ads manual unobstructed flow
quiz QUIZ-13 ads manual result 60/40 content/ads
quiz QUIZ-14 ads manual ad labels
quiz QUIZ-15 seo computed result canonical
quiz QUIZ-16 seo computed meta tags
quiz QUIZ-17 seo computed robots allows pages
quiz QUIZ-18 template computed shared boilerplate ≤30%, fail ≥50%
quiz QUIZ-19 template computed result overlap <40%
quiz QUIZ-20 template computed distinct categories
"""

#: pattern in a rejection message (lower case), theme, requirement ids
_REJECTIONS = """
low.?value = low value = CONTENT-01 CONTENT-03 CONTENT-04
original = not enough original content = CONTENT-02 CONTENT-08
thin = thin pages = CONTENT-03
crawler|cannot access = crawler cannot reach = CRAWL-01 CRAWL-02
privacy = privacy policy = PRIV-01 PRIV-02
placement = ad placement = PROG-06 PUB-10
policy violation = policy violation = PUB-01 PUB-02 PUB-03 PUB-04 PUB-05 PUB-06 PUB-07 PUB-08 PUB-09 PUB-10 PUB-11 PUB-12 PUB-13 PUB-14 PUB-15 PUB-16
"""

#: how often each kind of reason is given, in percent
_PRIORS = """
25 unfinished site
20 thin content
15 weak trust
12 too many ads
10 crawling
10 privacy policy
5 prohibited content
3 broken pages
"""

#: site type, the rubric that serves it
_SITE_TYPES = """
tool tool
quiz quiz
blog none
directory none
hybrid tool
hybrid quiz
"""

#: requirement, then the rubric checks that bear on it; none where only the page itself shows it
_BEARS = """
tool CONTENT-01 TOOL-01 TOOL-02 TOOL-03
tool CONTENT-02 TOOL-01
tool CONTENT-03 TOOL-02 TOOL-04
tool CONTENT-04
tool UX-01 TOOL-06
tool UX-02 TOOL-06
tool CRAWL-05 TOOL-11
quiz CONTENT-01 QUIZ-01 QUIZ-05 QUIZ-07
quiz CONTENT-02 QUIZ-02 QUIZ-04 QUIZ-19
quiz CONTENT-03 QUIZ-11
quiz CONTENT-04
quiz CONTENT-08 QUIZ-18 QUIZ-20
quiz UX-02 QUIZ-08
quiz CRAWL-05 QUIZ-15
"""

SEVERITY_RANK = {"Blocker": 1, "High": 2, "Medium": 3}


def _lines(text: str, most: int) -> list[list[str]]:
    return [x.split(" ", most) for x in text.strip().split("\n")]


REQUIREMENTS = [tuple(x) for x in _lines(_REQUIREMENTS, 4)]
RUBRICS = [tuple(x) for x in _lines(_RUBRICS, 4)]
REJECTIONS = [(n, p.strip(), t.strip(), f"ADS-{i}") for n, (p, t, ids) in enumerate((x.split(" = ") for x in _REJECTIONS.strip().split("\n")), 1) for i in ids.split()]
PRIORS = [(int(a), b) for a, b in _lines(_PRIORS, 1)]
SITE_TYPES = [(a, b) for a, b in _lines(_SITE_TYPES, 1)]


#: rubric, requirement id, check id (null where no check bears on it)
BEARS = [(r, f"ADS-{i}", c) for r, i, *checks in map(str.split, _BEARS.strip().split("\n")) for c in checks or [None]]


def bears(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEARS, "rubric string, id string, check_id string")


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "section string, id string, severity string, evidence_source string, topic string")


def rubrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBRICS, "rubric string, check_id string, area string, mode string, asks string")


def rejections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REJECTIONS, "reason_no int, pattern string, theme string, id string")


def priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRIORS, "rate int, reason string")


def site_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITE_TYPES, "site_type string, rubric string")
