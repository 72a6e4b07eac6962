"""Whether a repository is about AI: keywords by field, a score, and an ordered list of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence that stands on its own, tooling, ambiguous words, and hints against.
CORE = ("llm", "large language model", "generative ai", "machine learning", "deep learning", "artificial intelligence", "transformer", "diffusion", "rag", "retrieval augmented generation", "multimodal", "computer vision", "stable diffusion", "pytorch", "tensorflow", "huggingface", "langchain")
TOOLING = ("mcp", "model context protocol")
WEAK = ("ai", "agent", "agentic", "model", "vision", "inference", "embedding", "chat", "chatbot", "assistant", "copilot")
AGAINST = ("crm", "finance tracker", "todo", "game", "music player", "desktop utility", "adhd", "marketing website", "ecommerce store")
EXPLICIT = ("llm", "large language model", "stable diffusion", "transformer", "rag")
FIELD_SCORES = (("topics", 4), ("description", 3), ("name", 2))


def _words(low: Column) -> Column:
    """The runs of letters and digits of a text."""
    return F.split(low, "[^a-z0-9]+")


def _low(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[-_/]+", " ")


def _held(low: Column, words: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that a text (of _low) with some words (of _words) holds: one look at all words together, and one at the text for each phrase."""
    forms = {form: k for k in keywords if " " not in k for form in (k, f"{k}s")}
    known = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    single = F.array_distinct(F.transform(F.array_intersect(F.array(*[F.lit(form) for form in forms]), words), lambda form: known[form]))
    phrases = [F.when(F.contains(low, F.lit(k)), k) for k in keywords if " " in k]
    return F.concat(single, F.array_compact(F.array(*phrases))) if phrases else single


def found(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that a text holds: words of letters and digits with an optional plural, phrases anywhere; words first."""
    return _held(_low(text), _words(_low(text)), keywords)


def judged(repos: DataFrame, explicit: tuple[str, ...] = EXPLICIT) -> DataFrame:
    """repos (repo, name, description, more: description of the metadata or null, topics: array, strict) with score, route, accepted."""
    texts = {
        "topics": F.when(F.col("strict"), "").otherwise(F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")),
        "description": F.trim(F.concat_ws(" ", "description", F.when(~F.col("strict") & (F.col("more") != ""), F.col("more")))),
        "name": F.concat_ws(" ", "repo", "name"),
    }
    texts["all"] = F.concat_ws(" ", *texts.values())
    # each text is put in lower case and cut into words once, for all of its keywords
    out = repos.withColumns({f"_{field}_low": _low(t) for field, t in texts.items()})
    out = out.withColumns({f"_{field}_words": _words(F.col(f"_{field}_low")) for field in texts})
    kinds = {"core": CORE, "tool": TOOLING, "weak": WEAK}
    out = out.withColumns({f"_{field}_{kind}": _held(F.col(f"_{field}_low"), F.col(f"_{field}_words"), words) for field, _ in FIELD_SCORES for kind, words in kinds.items()})
    out = out.withColumn("_against", F.size(_held(F.col("_all_low"), F.col("_all_words"), AGAINST)) > 0)

    def size(field: str, kind: str) -> Column:
        return F.size(f"_{field}_{kind}")

    fields = [f for f, _ in FIELD_SCORES]
    strong = {f: size(f, "core") + size(f, "tool") for f in fields}
    extra = F.least(F.lit(2), sum((F.greatest(strong[f] - 1, F.lit(0)) for f in fields), F.lit(0)))
    weak = F.array_distinct(F.concat(*[F.col(f"_{f}_weak") for f in fields]))
    weak_fields = sum(((size(f, "weak") > 0).cast("int") for f in fields), F.lit(0))
    score = sum((F.when(strong[f] > 0, n).otherwise(0) for f, n in FIELD_SCORES), F.lit(0)) + extra + F.least(F.size(weak), F.lit(3))
    content_core = (size("description", "core") + size("name", "core")) > 0
    content_tool = (size("description", "tool") + size("name", "tool")) > 0
    any_core = content_core | (size("topics", "core") > 0)
    named = F.arrays_overlap("_name_core", F.array(*[F.lit(k) for k in explicit]))
    out = out.withColumn("score", score)
    strict = F.when(content_core & (F.col("score") >= 3), "core").when(named, "explicit-name").otherwise("none")
    normal = (
        F.when(content_core, "core")
        .when(named, "explicit-name")
        .when(any_core & (F.col("score") >= 6), "core")
        .when(content_tool & any_core, "tooling")
        .when((F.size(weak) >= 2) & (weak_fields >= 2) & any_core, "weak-keywords")
        .otherwise("none")
    )
    route = F.when(F.col("_against") & ~content_core, "none").when(F.col("strict"), strict).otherwise(normal)
    return out.withColumn("route", route).withColumn("accepted", F.col("route") != "none").select(*repos.columns, "score", "route", "accepted")
