"""Whether an extracted body is an article: measures of its paragraphs and an ordered list of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import WIDE, effective_length, paragraphs

# Wording of page furniture, matched against a whole lower-case paragraph.
NOISE = (
    r"^(accept|reject)( all)?( cookies?)?$",
    r"^manage (cookies|preferences|consent)$",
    r"^cookie (policy|preferences|settings|notice|banner)$",
    r"^(we|this site|our site) uses? cookies?.*$",
    r"^by (clicking|continuing|using).{0,80}cookies?.*$",
    r"^(sign|log) ?(in|up|out)( to .{0,30})?$",
    r"^subscribe( to .{0,40})?$",
    r"^(share|sharing|tweet|post|email|copy link|copy url)( this)?( (article|post|page|link))?$",
    r"^(related|recommended|popular|more) (articles|posts|stories|reading|news|content)$",
    r"^read (more|next|also)$",
    r"^(advertisement|sponsored content|sponsored|ad)$",
    r"^(newsletter|newsletters)$",
    r"^(menu|main menu|navigation|skip to (main )?content|back to top)$",
    r"^(previous|next)( (page|article|post))?$",
    r"^(page|pages) \d+( of \d+)?$",
    r"^\d+ (min|minute|minutes) read$",
    r"^(all rights reserved|©|copyright).*$",
    r"^(privacy|terms|terms of (use|service)|cookie policy|legal|contact|about)( .{0,20})?$",
    r"^(follow us|connect with us|stay in touch)( on .{0,40})?$",
    r"^(share on|follow on) (twitter|x|facebook|linkedin|reddit|whatsapp|mastodon)$",
    r"^tags?[:：].*$",
)


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_noise(paragraph: Column) -> Column:
    """A short paragraph that is only wording of page furniture."""
    return noise_folded(folded(paragraph))


def noise_folded(low: Column) -> Column:
    """The same of a folded paragraph."""
    return F.when((low == "") | (F.length(low) > 120), False).otherwise(F.trim(F.regexp_replace(low, r"^[#\->* ]+", "")).rlike("|".join(NOISE)))


def quality(text: Column, method: Column) -> Column:
    """Struct of verdict (good, low, fallback), chars, paragraphs, noise, duplicate and short ratios, and reason."""

    def measured(blocks: Column) -> Column:
        def counted(low: Column) -> Column:
            return F.struct(
                F.size(low).alias("n"),
                F.size(F.filter(low, lambda x: noise_folded(x))).alias("noise"),
                F.size(F.filter(blocks, lambda b: F.length(b) <= 45)).alias("short"),
                (F.size(low) - F.size(F.array_distinct(low))).alias("repeated"),
            )

        return bound(F.transform(blocks, folded), counted)

    def judged(m: Column) -> Column:
        n = m["n"]
        whole = F.when(n > 0, n)
        chars = F.length(F.trim(body))
        flat = F.trim(F.regexp_replace(body, r"\s+", " "))
        menu = flat.rlike("[|•·»«‣▸▶]") | ~F.substring(flat, 1, 200).rlike("[.!?。！？；;:…]")
        reason = (
            F.when((n == 0) | (chars == 0), "empty")
            .when(effective_length(body) < 400, F.when(method == "rss_summary", "short_summary").otherwise("too_short"))
            .when((n == 1) & menu, "menu_like")
            .when(m["noise"] / whole > 0.35, "noisy")
            .when(m["repeated"] / whole > 0.35, "repetitive")
            .when(m["short"] / whole > 0.6, "label_like")
            .otherwise("")
        )

        def told(why: Column) -> Column:
            verdict = F.when(why.isin("empty", "too_short"), "fallback").when(why == "", "good").otherwise("low")
            ratios = [F.coalesce(m[a] / whole, F.lit(0.0)).alias(b) for a, b in (("noise", "noise"), ("repeated", "duplicate"), ("short", "short"))]
            return F.struct(verdict.alias("verdict"), chars.alias("chars"), n.alias("paragraphs"), *ratios, why.alias("reason"))

        return bound(reason, told)

    body = F.coalesce(text, F.lit(""))
    return bound(bound(paragraphs(body), measured), judged)


def language(text: Column, least: int = 5) -> Column:
    """ja, ko, ru, zh, en or und by script counts of the first 4000 characters; empty for blank text."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)

    def count(pattern: str) -> Column:
        return F.regexp_count(head, F.lit(pattern))

    kana, hangul, cyrillic, cjk, latin = (count(p) for p in ("[぀-ヿ]", "[가-힯]", "[Ѐ-ӿ]", "[㐀-䶿一-鿿豈-﫿]", "[A-Za-z]"))
    return (
        F.when(F.trim(head) == "", "")
        .when(kana >= least, "ja")
        .when((hangul >= least) & (hangul > latin), "ko")
        .when((cyrillic >= least) & (cyrillic > latin), "ru")
        .when((cjk >= least) & (cjk >= latin), "zh")
        .when(latin > 0, "en")
        .otherwise("und")
    )
