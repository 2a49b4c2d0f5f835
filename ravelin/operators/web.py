"""Pages: links, URL rules, a traversal by depth, and readable text from HTML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.sources.files import stored


@dataclass
class CrawlSettings:
    domain: str
    seeds: list[str] = field(default_factory=list)
    max_pages: int = 2000
    max_depth: int = 2
    delay_s: float = 1.0
    allow_patterns: list[str] = field(default_factory=list)
    deny_patterns: list[str] = field(default_factory=list)


def canonical(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page columns' url, href) of every anchor target in quotes of either kind, whatever the case of tag and attribute; blank ones are none."""
    quoted = [F.regexp_extract_all(F.col(html), F.lit(f"(?i)<a\\s[^>]*?href\\s*=\\s*{q}([^{q}]+){q}"), F.lit(1)) for q in ('"', "'")]
    found = F.filter(F.transform(F.concat(*quoted), lambda h: F.trim(h)), lambda h: h != "")
    return pages.select(F.col(url), F.explode(found).alias("href"))


def _join_urls(base: pa.Array, href: pa.Array) -> pa.Array:
    return pa.array([urljoin(b or "", h or "") for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True)], pa.string())


def absolute(base: Column, href: Column) -> Column:
    """href resolved against its page, without a fragment."""
    return canonical(F.arrow_udf(_join_urls, "string")(base, href))


def allowed(url: Column, rules: CrawlSettings, deny_everywhere: list[str] | None = None) -> Column:
    """http or https, a host that ends with the domain, no deny pattern, and an allow pattern if there are any."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.parse_url(url, F.lit("AUTHORITY"))
    ok = scheme.isin("http", "https") & host.endswith(rules.domain)
    for p in [*(deny_everywhere or []), *rules.deny_patterns]:
        ok = ok & ~url.rlike(f"(?i){p}")
    if rules.allow_patterns:
        ok = ok & url.rlike("(?i)" + "|".join(f"(?:{p})" for p in rules.allow_patterns))
    return F.coalesce(ok, F.lit(False))


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of all nodes within max_depth links of a seed: a join per level, against those not seen before.

    Each level is written to the shared folder, so that the next one does not work it out again.
    """
    front = stored(seeds.select("node", F.lit(0).alias("depth")).distinct(), "level")
    seen = front
    for depth in range(1, max_depth + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = stored(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def crawl(pages: DataFrame, edges: DataFrame, rules: CrawlSettings, deny_everywhere: list[str] | None = None) -> DataFrame:
    """(url, depth, place, status, content_type, kept, skipped): what a walk from the seeds fetches, in order of depth, then URL.

    `pages` has url, status and content_type; a URL without a page is not found. Links are followed where the rules allow their
    canonical form. The walk ends with `max_pages` pages of status 200; those of another content type than HTML or PDF count but are
    marked skipped, those of another status are logged and not kept.
    """
    spark = pages.sparkSession
    first = spark.createDataFrame([(u,) for u in rules.seeds], "url string").select(canonical(F.col("url")).alias("node"))
    to = edges.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst"))
    found = traverse(first, to.where(allowed(F.col("dst"), rules, deny_everywhere)), rules.max_depth)
    # Of pages with one canonical URL, the one with the least status and type.
    known = pages.groupBy(canonical(F.col("url")).alias("url")).agg(F.min(F.struct("status", "content_type")).alias("p")).select("url", "p.*")
    got = found.withColumnRenamed("node", "url").join(known, "url")
    ok = (F.col("status") == 200).cast("int")
    # Pages that count are numbered level by level: a running sum over the levels' counts, then within the level.
    per = got.groupBy("depth").agg(F.sum(ok).alias("n"))
    ahead = per.select(F.col("depth").alias("d"), (F.sum("n").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    placed = got.join(F.broadcast(ahead), F.col("depth") == F.col("d")).withColumn("place", F.coalesce("before", F.lit(0)) + F.sum(ok).over(W.partitionBy("depth").orderBy("url").rowsBetween(W.unboundedPreceding, 0)))
    kind = F.lower(F.trim(F.split(F.col("content_type"), ";")[0]))
    wanted = kind.isin("text/html", "application/xhtml+xml", "application/pdf")
    return placed.where(F.col("place") <= rules.max_pages).select("url", "depth", "place", "status", kind.alias("content_type"), (F.col("status") == 200).alias("kept"), ((F.col("status") == 200) & ~wanted).alias("skipped"))


def page_name(url: Column) -> Column:
    """The name a page's bytes are stored under."""
    return F.sha1(url.cast("binary"))


# Fixed values.
DROP_TAGS = {"script", "style", "noscript", "svg", "canvas", "iframe", "form", "header", "footer", "nav", "aside"}
DROP_CLASSES = {"nav", "navbar", "menu", "footer", "header", "cookie", "cookies", "cookie-banner", "breadcrumb", "breadcrumbs", "subscribe", "newsletter", "social", "share", "sharing", "ad", "ads", "advert", "advertisement"}
DROP_IDS = {"cookie", "cookies"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
URL = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)


def link_label(url: str | None) -> str:
    """What stands for a link without words: its host, without www."""
    target = (url or "").strip()
    try:
        host = urlparse(target if "//" in target[:9] else f"//{target}" if target[:4].lower() == "www." else target).netloc
    except ValueError:
        host = ""
    return re.sub(r"^www\.", "", host.lower()) or "[link]"


class Reader(HTMLParser):
    """Collects text by the elements it stands in; an end tag closes what was opened since its start tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.found: dict[str, list[str]] = {"title": [], "h1": [], "main": [], "article": [], "body": [], "": []}
        self.first_done: set[str] = set()
        self.anchor: list[str] | None = None
        self.href = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        a = dict(attrs)
        drop = tag in DROP_TAGS or bool(DROP_CLASSES & set((a.get("class") or "").split())) or a.get("id") in DROP_IDS
        self.stack.append((tag, drop))
        if tag == "a" and not self.hidden():
            self.anchor, self.href = [], a.get("href") or ""

    def hidden(self) -> bool:
        return any(drop for _, drop in self.stack)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        if tag == "a" and self.anchor is not None and not self.hidden():
            shown = URL.sub("", " ".join(self.anchor)).strip()
            self.anchor = None
            self.emit(shown or link_label(self.href))
        while True:
            t, _ = self.stack.pop()
            if t in ("title", "h1", "main", "article", "body") and not any(x == t for x, _ in self.stack):
                self.first_done.add(t)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.hidden() or not data.strip():
            return
        if self.anchor is not None:
            self.anchor.append(data.strip())
        else:
            self.emit(URL.sub(" [link] ", data).strip())

    def emit(self, s: str) -> None:
        open_ = {t for t, _ in self.stack}
        for name in ("title", "h1", "main", "article", "body"):
            if name in open_ and name not in self.first_done:
                self.found[name].append(s)
        if "title" not in open_:
            self.found[""].append(s)


def readable(html: str | None) -> tuple[str, str]:
    """(title, text): the main, article or body text, a line for each piece."""
    r = Reader()
    r.feed(html or "")
    r.close()
    title = " ".join(r.found["title"]).strip() or " ".join(r.found["h1"]).strip()
    lines = next((r.found[k] for k in ("main", "article", "body", "") if r.found[k]), [])
    body = re.sub(r"[ \t]+", " ", "\n".join(lines).replace(" ", " "))
    return title, re.sub(r"\n{3,}", "\n\n", body).strip()


def _extract(html: pa.Array) -> pa.Array:
    pairs = [readable(h.decode("utf-8", "ignore") if isinstance(h, bytes) else h) for h in html.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["title", "text"])


def extract(html: Column) -> Column:
    """struct<title, text> of HTML text or bytes."""
    return F.arrow_udf(_extract, "struct<title string, text string>")(html)


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with what the manifest knows of their path; its last record counts, and a missing one leaves empty text and a null status."""
    last = manifest.groupBy(F.col("saved_path").alias("path")).agg(F.max_by(F.struct("url", "status"), "line").alias("m"))
    rows = files.join(last, "path", "left")
    url = F.coalesce(F.col("m.url"), F.lit(""))
    return rows.select(*files.columns, url.alias("source_url"), url.alias("final_url"), F.col("m.status").alias("status"))


def _try_extract(html: pa.Array) -> pa.Array:
    rows = []
    for h in html.to_pylist():
        try:
            title, body = readable(h.decode("utf-8", "ignore") if isinstance(h, bytes) else h)
            rows.append({"title": title, "text": body, "error": None})
        except Exception as e:  # a broken page goes to the dead letters, with what was wrong
            rows.append({"title": None, "text": None, "error": f"{type(e).__name__}: {e}"})
    return pa.array(rows, pa.struct([("title", pa.string()), ("text", pa.string()), ("error", pa.string())]))


def extract_documents(pages: DataFrame, html: str = "html", min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(documents, dead letters) of pages with url, domain and HTML: title and cleaned text by the domain's policy, and the errors.

    Documents of fewer than `min_chars` characters are left out. The pages are read once for both.
    """
    tried = F.arrow_udf(_try_extract, "struct<title string, text string, error string>")
    rows = stored(pages.withColumn("_x", tried(F.col(html))).drop(html), "extracted")
    title, url = F.col("_x.title"), F.col("url")
    body = T.clean_by_policy(F.col("_x.text"), F.col("domain"), url, url, title)
    good = rows.where(F.col("_x.error").isNull()).select(*[c for c in rows.columns if c != "_x"], title.alias("title"), body.alias("text"))
    bad = rows.where(F.col("_x.error").isNotNull()).select("url", F.col("_x.error").alias("error"))
    return good.where(F.length("text") >= min_chars), bad


def all_documents(crawled: DataFrame, flat: DataFrame) -> DataFrame:
    """Crawled documents and flat files as one table; what either side lacks is null."""
    return crawled.withColumn("source", F.lit("crawl")).unionByName(flat.withColumn("source", F.lit("baseline_data")), allowMissingColumns=True)
