"""Article text from page markup, as Arrow-batched helpers over (html, url, fallback). All lists of patterns are fields of ``PageRules``."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import prose as R
from newsloom.functions import text as T

_TAG, _SPACE = re.compile(r"<[^>]*>"), re.compile(r"\s+")
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_PARAGRAPH = re.compile(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|</div>|\Z)")
_ARTICLE = re.compile(r"(?is)<article\b[^>]*>(.*?)(</article>|\Z)")
_LD = re.compile(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>")
# The keys under which pages embed their text, in order of trust.
_KEYS = ["articleBody", "description", "summary", "excerpt", "seoDescription", "subHeadline"]
_EMBEDDED = re.compile(r'(?is)"(%s)"\s*:\s*"((?:[^"\\]|\\.){80,4000})"' % "|".join(_KEYS))
_META_TAG = re.compile(r"(?is)<meta\b[^>]*>")
_ATTRIBUTE = re.compile(r"(?is)([a-z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_QUALITIES = ("rss_only", "metadata_description", "article_body")
_FLAT_TOKEN = re.compile("[a-z0-9]{4,}")


@dataclass(frozen=True)
class PageRules:
    """Own short defaults; pass others for other desks and sites."""

    fragments: tuple[str, ...] = (r"(?i)\((?:picture|illustration|credit)s?\b[^()]{0,80}\)", r"(?i)^(?:picture|illustration|source) ?: ?[^.]{0,60}\.", r"(?i)^(?:words|text) by [A-Z][a-z]+ [A-Z][a-z]+[.,]? ?", r"(?i)^(?:also|more) on this:\s*", r"(?i)\s+(?:enlarge|open) picture$")
    non_narrative: tuple[str, ...] = tuple(T.NON_NARRATIVE)
    boilerplate: tuple[str, ...] = ("privacy settings", "terms and conditions", "mailing list", "tap here", "related stories", "paid content", "automatic transcript", "copyright of")
    #: Patterns after which a site's paragraphs start, by domain; their windows are this long.
    markers: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"example.org": (r'itemprop="articleBody"', r'class="[^"]*body-text')})
    window: int = 18_000
    #: Domains whose pages may be live blogs, and texts that a site puts on every page.
    live: tuple[str, ...] = ("example.com",)
    site_texts: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"example.net": (r"(?i)^sponsored content$",)})
    paywalled: tuple[str, ...] = ("paid.example",)
    paywall_hints: tuple[str, ...] = (r"(?i)subscribe to (?:continue|read)", r"(?i)class=\"[^\"]*paywall")
    blocks: tuple[tuple[str, str], ...] = (("robot check", r"(?i)are you a robot"), ("refused", r"(?i)<title>[^<]*(?:403|forbidden)"))
    entity_stop: tuple[str, ...] = tuple(T.LOW_SIGNAL_ENTITIES)
    stopwords: tuple[str, ...] = ("that", "with", "from", "this", "have", "said", "were", "they")


RULES = PageRules()


def strip_html(text: str | None) -> str:
    """Tags to spaces, entities to characters, white space to single spaces."""
    return _SPACE.sub(" ", entities.unescape(_TAG.sub(" ", text or ""))).strip()


def sanitize(text: str, fragments: tuple[str, ...] | list[str] = RULES.fragments) -> str:
    """Credits, bylines and promotion removed until nothing more goes, spacing before marks mended."""
    while True:
        new = text
        for f in fragments:
            new = re.sub(f, " ", new)
        new = re.sub(r" +([.,;:!?])", r"\1", _SPACE.sub(" ", new)).strip()
        if new == text:
            return text
        text = new


def non_narrative(text: str, rules: PageRules = RULES) -> bool:
    """The Python form of ``text.is_non_narrative``."""
    if len(text) < 60 or any(re.search(p, text) for p in rules.non_narrative):
        return True
    if not re.search(T.CAPTION_OPENING, text):
        return False
    return bool(re.search(T.DAY_OR_MONTH, text) or (re.search(T.CAPTION_SCENE, text) and not re.search(T.REPORTING, text)))


def clipped(text: str) -> bool:
    """The Python form of ``text.looks_clipped``."""
    if re.search(T.INITIAL, text):
        return True
    unclosed = text.count("“") > text.count("”") or text.count('"') % 2 == 1
    return len(text) >= T.CLIPPED_FROM and (unclosed or not re.search(r"[.!?]$", text) or text.endswith("...") or bool(re.search(T.STUMP, text)))


def clamp(text: str, most: int) -> str:
    """Up to the last sentence end in the last 45 %, else to a word's end with an ellipsis."""
    if len(text) <= most:
        return text
    stop = re.match(r"(?s)(.*[.!?])\s", text[:most])
    if stop and stop.end() >= int(most * 0.55):
        return stop[1]
    return re.sub(r"\s+\S*$", "", text[:most]).strip() + "..."


def snippet(text: str | None, most: int) -> str:
    """The Python form of ``text.clean_snippet``."""
    whole = _SPACE.sub(" ", text or "").strip()
    short = clamp(whole, most)
    if not clipped(short):
        return short
    first = re.match(r"(.+?[.!?])(?:\s|$)", whole)
    return first[1] if first and len(first[1]) >= 60 else ""


def split_sentences(text: str | None) -> list[str]:
    """The Python form of ``prose.sentences``."""
    out: list[str] = []
    for piece in re.sub(R.CUT, "\\1\n\\2", _SPACE.sub(" ", text or "").strip()).split("\n"):
        if out and (re.search(R.SHORT, out[-1]) or out[-1].count('"') % 2 or out[-1].count("“") > out[-1].count("”") or (re.search(R.QUOTED, out[-1]) and re.match(R.ATTRIBUTION, piece))):
            out[-1] = f"{out[-1]} {piece}"
        elif piece:
            out.append(piece)
    return out


def _tokens(text: str) -> set[str]:
    return set(_FLAT_TOKEN.findall(text.lower()))


def alignment(reference: str, candidate: str, rules: PageRules = RULES) -> float:
    """Shared tokens over the fewer of both, 0 where a side has under four."""
    a, b = (_tokens(sanitize(x, rules.fragments)) - set(rules.stopwords) for x in (reference, candidate))
    return len(a & b) / min(len(a), len(b)) if min(len(a), len(b)) >= 4 else 0.0


def meta(page: str, names: tuple[str, ...]) -> str:
    """Content of the first of the named meta tags that has some."""
    found: dict[str, str] = {}
    for tag in _META_TAG.findall(page):
        pairs = {k.lower(): a or b for k, a, b in _ATTRIBUTE.findall(tag)}
        for key in ("property", "name"):
            if pairs.get(key) and pairs.get("content"):
                found.setdefault(pairs[key].lower(), pairs["content"])
    return next((entities.unescape(found[n]).strip() for n in names if found.get(n)), "")


def _ld_nodes(page: str) -> Iterator[dict]:
    """Every object of the JSON-LD scripts, outer ones first."""
    for block in _LD.findall(page):
        try:
            rest = [json.loads(entities.unescape(block).strip())]
        except ValueError:
            continue
        while rest:
            node = rest.pop(0)
            if isinstance(node, dict):
                yield node
            rest[:0] = [v for v in (node.values() if isinstance(node, dict) else node) if isinstance(v, (dict, list))]


def jsonld_text(page: str, rules: PageRules = RULES) -> list[str]:
    """Narrative descriptions and article bodies in JSON-LD scripts, in document order."""
    texts = (strip_html(node[key]) for node in _ld_nodes(page) for key in ("description", "articleBody") if isinstance(node.get(key), str))
    return list(dict.fromkeys(t for t in texts if not non_narrative(t, rules)))


def live_updates(page: str, most: int = 2, least: float = 0.12, share: float = 0.45, rules: PageRules = RULES) -> list[str]:
    """The updates of a live blog that fit its own headline best, in page order.

    An update scores by the alignment of its body, and 0.6 of that of its headline. Those of the ``most`` best count that reach ``least`` and
    ``share`` of the best; where none fits, the best alone."""
    words = lambda node, keys: " ".join(str(node.get(k) or "").strip() for k in keys).strip()
    for node in _ld_nodes(page):
        if node.get("@type") != "LiveBlogPosting" or not isinstance(node.get("liveBlogUpdate"), list):
            continue
        anchor, rated = words(node, ("headline", "name", "description", "alternateName")), []
        for update in node["liveBlogUpdate"]:
            body = sanitize(strip_html(update.get("articleBody")), rules.fragments) if isinstance(update, dict) and isinstance(update.get("articleBody"), str) else ""
            if len(body) >= 80 and not non_narrative(body, rules):
                rated.append((alignment(anchor, body, rules) + 0.6 * alignment(anchor, words(update, ("headline", "name", "articleSection")), rules), body))
        order = sorted(range(len(rated)), key=lambda k: (-rated[k][0], k))
        if order:
            best = rated[order[0]][0]
            chosen = order[:1] if best < least else [k for k in order[:most] if rated[k][0] >= max(least, share * best)]
            return list(dict.fromkeys(rated[k][1] for k in sorted(chosen)))
    return []


def embedded_json_text(page: str, most: int = 8, least: int = 80, rules: PageRules = RULES) -> list[str]:
    """Long narrative strings under known keys of JSON anywhere in the page, distinct, key by key."""
    by_key: dict[str, list[str]] = {k.lower(): [] for k in _KEYS}
    for key, raw in _EMBEDDED.findall(page):
        try:
            value = json.loads(f'"{raw}"', strict=False)
        except ValueError:
            value = raw.replace('\\"', '"')
        by_key[key.lower()].append(sanitize(strip_html(value), rules.fragments))
    once = {t.lower(): t for t in reversed([t for texts in by_key.values() for t in texts if len(t) >= least and not non_narrative(t, rules)])}
    return list(reversed(once.values()))[:most]


def _paragraphs(markup: str, most: int, least: int, rules: PageRules, seen: dict[str, str]) -> None:
    for raw in _PARAGRAPH.findall(markup):
        if len(seen) >= most:
            return
        text = sanitize(strip_html(raw), rules.fragments)
        low = text.lower()
        if len(text) >= least and low not in seen and not any(b in low for b in rules.boilerplate) and not non_narrative(text, rules):
            seen[low] = text


def article_paragraphs(page: str, most: int = 5, least: int = 60, rules: PageRules = RULES) -> list[str]:
    """Narrative paragraphs of the first <article>, else of the page: long, distinct, without boilerplate."""
    visible, seen = _HIDDEN.sub(" ", page), {}
    inner = _ARTICLE.search(visible)
    _paragraphs(inner[1] if inner else visible, most, least, rules, seen)
    return list(seen.values())


def domain_of(url: str | None) -> str:
    host = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return re.sub("^www\\.", "", host[1].lower()) if host else ""


def _of_domain(domain: str, known: str) -> bool:
    return domain == known or domain.endswith("." + known)


def source_paragraphs(page: str, url: str | None, most: int = 5, rules: PageRules = RULES) -> list[str]:
    """Paragraphs in the windows after the markers of the url's domain."""
    seen: dict[str, str] = {}
    for known, markers in rules.markers.items():
        if _of_domain(domain_of(url), known):
            for found in (m for marker in markers for m in re.finditer(marker, page, re.IGNORECASE)):
                _paragraphs(_HIDDEN.sub(" ", page[found.start() : found.start() + rules.window]), most, 60, rules, seen)
    return list(seen.values())


def named_entities(text: str, most: int = 8, rules: PageRules = RULES) -> list[str]:
    """The Python form of ``text.named_entities``."""
    runs = re.findall(T.ENTITY, _SPACE.sub(" ", text).strip())
    return list(dict.fromkeys(r for r in runs if len(r) >= 4 and r.lower() not in rules.entity_stop))[:most]


@dataclass(frozen=True)
class Enrichment:
    """What a page gives: the defaults where it is blocked."""

    lede: str
    body_preview: str = ""
    paragraphs: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    extraction_quality: str = _QUALITIES[0]
    access_signal: str = "unknown"
    image: str | None = None
    block_reason: str | None = None
    block_vendor: str | None = None


def fetch_block(page: str, status: int | None = None, rules: PageRules = RULES) -> tuple[str, str] | None:
    vendor = next((v for v, p in rules.blocks if re.search(p, page)), None)
    if vendor:
        return "anti_bot_challenge", vendor
    return ("http_access_denied", "generic") if status in (401, 403, 429) else None


def enrich(page: str | None, url: str | None = None, fallback: str | None = None, status: int | None = None, rules: PageRules = RULES) -> Enrichment:
    """Lede (the first usable of paragraph, description, embedded texts, JSON-LD texts, fallback), body preview, grade, entities, access and image."""
    domain = domain_of(url)
    paid = any(_of_domain(domain, d) for d in rules.paywalled)
    block = fetch_block(page or "", status, rules)
    if block or not page:
        return Enrichment(snippet(fallback, 320), access_signal="likely_paywalled" if paid else "unknown", block_reason=block and block[0], block_vendor=block and block[1])
    own = [p for known, patterns in rules.site_texts.items() if _of_domain(domain, known) for p in patterns]
    clean = lambda texts: [t for t in texts if not any(re.search(p, t) for p in own)]
    paragraphs, live = clean(article_paragraphs(page, rules=rules)), any(_of_domain(domain, d) for d in rules.live)
    special = clean(live_updates(page, rules=rules) if live else [])
    if special:
        paragraphs = special
    else:
        special = clean(source_paragraphs(page, url, rules=rules))
        paragraphs = special if len(" ".join(special)) > len(" ".join(paragraphs)) else paragraphs
    described = "".join(clean([meta(page, ("og:description", "description", "twitter:description"))]))
    embedded, ld = embedded_json_text(page, rules=rules), jsonld_text(page, rules)
    lede = next((s for s in (snippet(x, 320) for x in (*paragraphs[:1], described, *embedded[:2], *ld[:2], fallback)) if s), "")
    body = clamp(" ".join(paragraphs[:3] or embedded[:2] or ld[:2]), 1200)
    return Enrichment(
        lede, body, tuple(paragraphs), tuple(named_entities(f"{lede} {body}", rules=rules)), _QUALITIES[2] if paragraphs else _QUALITIES[1] if described or embedded or ld else _QUALITIES[0],
        "likely_paywalled" if paid or any(re.search(p, page) for p in rules.paywall_hints) else "open", meta(page, ("og:image", "twitter:image")) or None,
    )


_ENRICHED = "lede string, body_preview string, paragraphs array<string>, entities array<string>, extraction_quality string, access_signal string, image string, block_reason string, block_vendor string"


def extract_pages(pages: DataFrame, id_col: str, html_col: str, url: Column, fallback: Column, status: Column | None = None, rules: PageRules = RULES) -> DataFrame:
    """(id and the fields of Enrichment) of every page, in Arrow batches of whole pages."""
    columns = [c.split()[0] for c in _ENRICHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [enrich(h, u, f, None if pd.isna(s) else int(s), rules) for h, u, f, s in zip(batch.html, batch.url, batch.fallback, batch.status, strict=True)]
            yield batch[["id"]].assign(**{c: [list(v) if isinstance(v, tuple) else v for v in (getattr(e, c) for e in found)] for c in columns})

    frame = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), url.alias("url"), fallback.alias("fallback"), (F.lit(None) if status is None else status).cast("int").alias("status"))
    out = frame.mapInPandas(run, f"id {frame.schema['id'].dataType.simpleString()}, {_ENRICHED}")
    return out.withColumnRenamed("id", id_col)


def hidden_text(markup: Column) -> Column:
    """struct(jsonld, embedded, live): the texts of JSON-LD scripts, of JSON anywhere in a page, and of live updates."""

    @F.pandas_udf("jsonld array<string>, embedded array<string>, live array<string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({name: pages.map(lambda p, f=f: f(p or "")) for name, f in (("jsonld", jsonld_text), ("embedded", embedded_json_text), ("live", live_updates))})

    return run(markup)
