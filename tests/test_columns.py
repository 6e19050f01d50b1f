"""Column functions against the cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions import contact as C
from attestry.functions import review as V
from attestry.functions import scoring as SC
from attestry.functions import text as T
from attestry.functions import urls as U

c = F.col


def text_of(one, fn, value):
    return one(fn(c("x")), x=("string", value))


@pytest.mark.parametrize("number, digits, key", [
    ("(510) 654-4000 ext. 105", "5106544000", "5106544000"),
    ("+1 415 733 0990", "14157330990", "4157330990"),
    ("311", "311", None), (None, "", None)])
def test_phone_digits_and_key(one, number, digits, key):
    assert text_of(one, C.phone_digits, number) == digits
    assert text_of(one, C.phone_key, number) == key


@pytest.mark.parametrize("number, label, cc, kind, proposed", [
    ("", "(415) 333-3017", None, "empty", "(415) 333-3017"),
    (None, "Voice", "US", "empty", None),
    ("41574423832383", "Voice", "US", "run_together", None),
    ("057 012 31 17", "TTY", "CH", "foreign", None),
    ("311", "", "US", None, None), ("711", None, None, None, None),
    ("838255", None, "US", None, None)])
def test_structural_defects(one, number, label, cc, kind, proposed):
    issue = one(C.phone_issue(F.lit(1), c("n"), c("l"), c("k")), n=("string", number),
                l=("string", label), k=("string", cc))
    assert (issue["kind"] if issue else None) == kind
    assert (issue["proposed"] if issue else None) == proposed


@pytest.mark.parametrize("stored, page, expected", [
    ("450 SUTTER ST 2522, San Francisco", "450 Sutter St, Suite 2522", True),
    ("P.O. Box 23403, Oakland", "write to PO Box 23403", True),
    ("P.O. Box 23403, Oakland", "nothing here", False),
    ("California St, SF", "California St", None), ("12 St", "12 St", None),
    ("433 Hegenberger Rd., Oakland", "somewhere else", False)])
def test_address_oracle_is_three_valued(one, stored, page, expected):
    assert one(C.address_on_page(c("s"), c("p")), s=("string", stored),
               p=("string", page)) is expected


def test_phone_oracle_ignores_formatting(one):
    assert one(C.phone_on_page(c("s"), c("p")), s=("string", "(415) 733-0990"),
               p=("string", "call 415.733.0990")) is True
    assert one(C.phone_on_page(c("s"), c("p")), s=("string", "0990"),
               p=("string", "0990")) is False


@pytest.mark.parametrize("url, domain", [
    ("https://bfwc.org/get-help/", "bfwc.org"), ("http://www.example.com", "example.com"),
    ("sub.deep.example.com", "example.com"), ("", ""), (None, ""),
    ("https://user@Sub.Example.com:8080/x", "example.com"), ("http://localhost/admin", "localhost"),
    ("foo//bar", "")])
def test_registered_domain(one, url, domain):
    assert text_of(one, U.registered_domain, url) == domain


@pytest.mark.parametrize("url, same", [
    ("https://bfwc.org/contact/", True), ("https://www.bfwc.org/x", True),
    ("https://evil.test/x", False), ("https://bfwc.org.evil.test/x", False),
    ("http://127.0.0.1/", False), ("http://169.254.169.254/latest/meta-data/", False)])
def test_same_site(one, url, same):
    assert one(U.same_site(c("u"), F.lit("https://bfwc.org/")), u=("string", url)) is same


ROBOTS = ("User-agent: *\nDisallow: /wp-admin/ # admin\nDisallow: /private\nDisallow:\n"
          "User-agent: other\nDisallow: /everything\nSitemap: https://x.test/s.xml\n")


def test_robots(one):
    r = text_of(one, U.parse_robots, ROBOTS)
    assert r["disallow"] == ["/wp-admin/", "/private"]
    assert r["sitemaps"] == ["https://x.test/s.xml"]
    for url, ok in (("https://x.test/get-help/", True), ("https://x.test/wp-admin/e.php", False),
                    ("https://x.test/private/notes", False)):
        assert one(U.robots_allow(F.lit(url), c("d")), d=("array<string>", r["disallow"])) is ok
    assert one(U.robots_allow(F.lit("https://x.test/a"), F.array().cast("array<string>"))) is True


INDEX = """<?xml version="1.0"?>
<sitemapindex><sitemap><loc><![CDATA[https://x.test/page-sitemap.xml]]></loc></sitemap>
<sitemap><loc>https://x.test/post-sitemap.xml</loc></sitemap></sitemapindex>"""
URLSET = """<urlset>
 <url><loc><![CDATA[https://x.test/get-help/]]></loc><lastmod>2026-09-18T06:59:00+00:00</lastmod></url>
 <url><loc>https://x.test/contact/</loc><lastmod>2026-08-14</lastmod></url>
 <url><loc>https://x.test/no-date/</loc></url></urlset>"""


def test_sitemaps(one):
    s = text_of(one, U.parse_sitemap, INDEX)
    assert s["children"] == ["https://x.test/page-sitemap.xml", "https://x.test/post-sitemap.xml"]
    assert s["pages"] == []
    s = text_of(one, U.parse_sitemap, URLSET)
    assert s["children"] == []
    assert [tuple(p) for p in s["pages"]] == [
        ("https://x.test/get-help/", "2026-09-18"), ("https://x.test/contact/", "2026-08-14"),
        ("https://x.test/no-date/", None)]
    bare = text_of(one, U.parse_sitemap, "<loc>https://x.test/a</loc>")
    assert [p["url"] for p in bare["pages"]] == ["https://x.test/a"]


def test_dates_and_slugs(one):
    assert text_of(one, U.day_of, "2026-09-18T06:59:00+00:00") == "2026-09-18"
    assert text_of(one, U.day_of, "not a date") is None
    assert text_of(one, U.slug_words, "/services/domestic-violence/") == [
        "services", "domestic", "violence"]


def test_html_text_drops_unclosed_script(one):
    html = ("<p>Hi &amp; bye</p><script>var a=1;</script><STYLE>x</STYLE>more"
            '<script>{"RelocatedPagesModal":"true"}')
    assert text_of(one, T.text_from_html, html) == "Hi & bye more"


def test_links(one):
    html = ('<a href="/a">x</a><a class=b href=\'b.html\'>y</a><a href="mailto:q@x">z</a>'
            '<a href="/a">again</a><a href="#top">t</a><a href="https://o.test/p#f">o</a>')
    got = one(U.html_links(c("h"), F.lit("https://x.test/dir/page")), h=("string", html))
    assert got == ["https://x.test/a", "https://x.test/dir/b.html", "https://o.test/p#f"]
    crawl = one(U.crawl_links(c("h"), F.lit("https://x.test/dir/page")), h=("string", html))
    assert crawl == ["https://x.test/a", "https://x.test/dir/b.html", "https://o.test/p"]


@pytest.mark.parametrize("support, contradict, label", [
    (.02, .01, "absent"), (0.0, K.CONTRADICT_THRESHOLD, "contradicted"),
    (K.SUPPORT_THRESHOLD, .03, "supported"), (.55, .40, "uncertain"), (0.0, .98, "uncertain")])
def test_labels(one, support, contradict, label):
    assert one(SC.classify(F.lit(support), F.lit(contradict))) == label


def test_thresholds_are_asymmetric():
    assert K.CONTRADICT_THRESHOLD > K.SUPPORT_THRESHOLD
    assert K.SUPPORT_THRESHOLD not in (0.5, 0.8, 0.85, 0.9)


@pytest.mark.parametrize("evidence, age, score", [
    ("human_verified", 0, 100.0), ("human_verified", 1095, 50.0), ("structural_ok", 0, 40.0),
    ("none", 0, 0.0), ("human_verified", None, 0.0)])
def test_field_score(one, evidence, age, score):
    assert one(SC.field_score(F.lit("phone"), F.lit(evidence), c("a")), a=("int", age)) == score


def test_age_needs_an_offset_and_clamps(one):
    def age(ts, clamp=True):
        return one(SC.age_days(c("t"), "2024-01-10T00:00:00Z", clamp), t=("string", ts))

    assert age("2024-01-01T00:00:00Z") == 9
    assert age("2024-01-01T12:00:00+00:00") == 8
    assert age("2024-01-01") is None and age("junk") is None and age(None) is None
    assert age("2024-01-10T06:00:00Z") == 0
    assert age("2024-01-10T06:00:00Z", clamp=False) == -1


@pytest.mark.parametrize("score, band", [(70, "fresh"), (69.9, "aging"), (40, "aging"),
                                         (15, "stale"), (14.9, "expired")])
def test_bands(one, score, band):
    assert one(SC.band(F.lit(float(score)))) == band


@pytest.mark.parametrize("reply, kind, action", [
    ("yes", "action", "confirm"), ("n", "action", "reject"), ("Y 👍", "action", "confirm"),
    ("/queue", "queue", None), ("?", "evidence", None), ("  ", "unknown", None),
    ("done", "stop", None), ("yellow", "unknown", None)])
def test_replies(one, reply, kind, action):
    r = text_of(one, V.parse_reply, reply)
    assert (r["kind"], r["action"]) == (kind, action)


@pytest.mark.parametrize("kind, asked, recorded", [
    ("structural", "confirm", "needs_fixing"), ("structural", "reject", "looks_right"),
    ("abstention", "confirm", None), ("discrepancy", "confirm", "confirm"),
    ("discrepancy", "looks_right", None), ("abstention", "skip", "skip")])
def test_legal_actions(one, kind, asked, recorded):
    assert one(V.settle_action(F.lit(kind), F.lit(asked))) == recorded


@pytest.mark.parametrize("field, label", [
    ("phone_missing", "phone number"), ("hours_mismatch", "opening hours"),
    ("operating_status", "open/closed status"), ("pet_policy", "pet policy")])
def test_field_labels(one, field, label):
    assert text_of(one, V.field_label, field) == label


def test_clean_text(one):
    assert text_of(one, T.clean_text, "a\u0007\u000b b\u0085 c ") == "a b c"
    assert one(T.clean_text(c("x"), "none"), x=("string", " \n")) == "none"
