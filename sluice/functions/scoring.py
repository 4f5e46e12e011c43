"""Scores of search results against what was looked for, and rules about links."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit

from sluice.functions.kernels import clean_snippet, partial_ratio, plain

# Query parameters that only track.
TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid srsltid ref".split())


def clean_link(url: str | None) -> str:
    """A link without scheme and tracking."""
    parts = urlsplit((url or "").strip())
    query = urlencode([(k, v) for k, v in parse_qsl(parts.query) if k.lower() not in TRACKING])
    return (parts.netloc + parts.path).rstrip("/") + ("?" + query if query else "")


def normalize_site(url: str | None) -> str:
    """Host and path of a link, without www. and shop."""
    parts = urlsplit(url if "//" in (url or "") else "//" + (url or ""))
    return re.sub(r"^(?:www|shop)\.", "", parts.netloc.lower()) + parts.path.rstrip("/")


def is_product_url(url: str | None) -> tuple[int, str]:
    """From -2 (surely no product page) to 2 (surely one), and why."""
    path = urlsplit(url or "").path.lower()
    if not path.strip("/"):
        return -2, "no path"
    if re.search(r"/(?:blog|news|about|contact|support|login|cart|forum|wiki)(?:/|$)", path):
        return -2, "page of another kind"
    if re.search(r"/(?:search|category|categories|collections?)(?:/|$)", path) and "/products/" not in path:
        return -1, "listing"
    if re.search(r"/(?:p|dp|product|products|item|itm|sku)/[\w-]+", path):
        return 2, "product path"
    if re.search(r"\.pdf$", path):
        return -1, "document"
    return (1, "code in path") if re.search(r"[a-z]*\d{3,}", path) else (0, "nothing tells")


def _items(x) -> list[str]:
    if x is None:
        return []
    return [str(v) for v in x] if isinstance(x, list) else [str(x)]


def ranked(
    results, suppliers=None, part_codes=None, mpns=None, descriptions=None, *, must_match_part_code: bool = True, blacklist_keywords="", mpn_exact_score: float = 8.0,
    mpn_partial_base: float = 4.0, part_code_exact_score: float = 6.0, part_code_partial_base: float = 2.0, supplier_exact_score: float = 3.0, supplier_partial_base: float = 1.0,
    context_match_base: float = 2.0, partial_threshold: float = 0.8, **_,
) -> list[dict]:
    """Results with score and reasons, the best first; unmatched and blacklisted ones go."""
    banned = [b.strip().lower() for b in (blacklist_keywords.split(",") if isinstance(blacklist_keywords, str) else blacklist_keywords) if b.strip()]
    flat = [r for block in (results or []) for r in (block.get("search_results", [block]) if isinstance(block, dict) else [])]
    out = []
    for r in flat:
        raw = " ".join(str(r.get(k) or "") for k in ("title", "snippet", "link", "url"))
        if any(b in raw.lower() for b in banned):
            continue
        text, score, reasons, matched = plain(raw), 0.0, [], False
        for label, terms, exact, base in (("mpn", mpns, mpn_exact_score, mpn_partial_base), ("part code", part_codes, part_code_exact_score, part_code_partial_base), ("supplier", suppliers, supplier_exact_score, supplier_partial_base)):
            for term in _items(terms):
                token = plain(term)
                if not token:
                    continue
                ratio = partial_ratio(token, text)
                if ratio == 1:
                    score, matched = score + exact, matched or label != "supplier"
                    reasons.append(f"{label} {term}")
                elif ratio >= partial_threshold:
                    score, matched = score + base * ratio, matched or label != "supplier"
                    reasons.append(f"{label} {term} in part")
        words = {plain(w) for d in _items(descriptions) for w in d.split()} - {""}
        if words:
            score += context_match_base * sum(w in text for w in words) / len(words)
        if must_match_part_code and (mpns or part_codes) and not matched:
            continue
        out.append({**r, "snippet": clean_snippet(r.get("snippet")), "score": round(score, 3), "reasons": reasons})
    return sorted(out, key=lambda r: -r["score"])


def as_text(results: list[dict]) -> str:
    """Results as lines to read."""
    return "\n".join(f"{k}. {r.get('title', '')} ({clean_link(r.get('link') or r.get('url'))}): {clean_snippet(r.get('snippet'))}" for k, r in enumerate(results or [], 1))
