"""Routing of natural-language queries: marker rules, subjects and search terms, as columns over a query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import normalized
from .safety import any_of

#: Words that carry no subject.
STOPWORDS = (
    "ara arat bul bulur bulabilir dosya dosyalar dosyaları dosyayı dosyalari içinde icinde geçen gecen olan ile ilgili alakalı alakali her şey sey "
    "şeyi seyi göster goster nerede search find file files inside contains containing related everything show the a an for content code source text "
    "metin kod adı adi isimli name named yanlış yanlis yazdım yazdim olabilir benzer fuzzy exact yaklaşık yaklasik eslesme eşleşme yap bana bunu şunu sunu"
).split()
#: Markers of each intent, asked in this order.
MARKERS = {
    "Help": ["yardım", "yardim", "help", "nasıl kullan", "nasil kullan"],
    "WebLookup": ["internette", "internetten", "search web", "web search", "internet search", "internette araştır", "internette arastir", "webde araştır", "webde arastir", "ne işe yarıyor", "ne ise yariyor", "what is ", "look up online"],
    "FuzzySearch": ["yanlış yaz", "yanlis yaz", "benzer", "yaklaşık", "yaklasik", "fuzzy", "typo", "approximate", "misspell", "olabilir"],
    "ContentSearch": ["içinde", "icinde", "geçen", "gecen", "contains", "containing", "content", "kodunda", "metninde", "text inside", "source contains"],
    "CleanupAnalysis": ["gereksiz", "temizle", "cleanup", "clean up", "temporary", "temp files", "orphan", "duplicate", "cache dos", "cache file", "eski build", "old build"],
    "RelatedSearch": ["ile ilgili", "ilgili her", "alakalı", "alakali", "related to", "everything related", "everything about"],
}
#: What makes the user interface ask the router at all.
NATURAL = ["içinde", "icinde", "geçen", "gecen", "contains", "containing", "alakalı", "alakali", "related", "benzer", "fuzzy"]
#: Fixed values: (canonical name, substring of the query without blanks and hyphens, words, aliases), asked in this order.
RELATIONS = [
    ("node.js", "nodejs", ["node", "npm", "npx"], ["node", "node.exe", "npm", "npx", "corepack", "package.json", "package-lock.json", "node_modules", ".npmrc", "npm-cache"]),
    ("rust", "rustlang", ["rust", "rustc", "cargo"], ["rustc", "cargo", "cargo.toml", "cargo.lock", ".cargo", "target"]),
    ("python", None, ["python", "python3", "pip", "pip3"], ["python", "python.exe", "python3", "pip", "pip3", "pyproject.toml", "requirements.txt", ".venv", "venv", "__pycache__"]),
    ("git", None, ["git", "github"], ["git", "git.exe", ".git", ".gitignore", ".gitattributes", ".gitconfig"]),
    ("steam", None, ["steam"], ["steam", "steam.exe", "steamapps", "libraryfolders.vdf", "appmanifest_"]),
]
SEPARATORS = r"""[\s,;:"'()\[\]]+"""


def relation(query: Column) -> Column:
    """The canonical name of the alias set that a query asks for, or null. A canonical name asks for its own set."""
    return relation_of(normalized(query))


def relation_of(q: Column) -> Column:
    """``relation`` of a query in its normal form."""
    packed = F.regexp_replace(q, "[ -]", "")
    words = F.split(q, r"\s+")
    out = F.lit(None).cast("string")
    for canonical, inside, asked, _ in reversed(RELATIONS):
        fits = F.arrays_overlap(words, F.array(*map(F.lit, asked)))
        out = F.when(fits | F.contains(packed, F.lit(inside)) if inside else fits, canonical).otherwise(out)
    return out


def aliases(query: str) -> tuple[str, list[str]] | None:
    """``relation`` for one query on the driver, with the set's aliases."""
    q = query.lower()
    packed, words = q.replace(" ", "").replace("-", ""), q.split()
    for canonical, inside, asked, names in RELATIONS:
        if (inside and inside in packed) or any(w in asked for w in words) or q.strip() == canonical:
            return canonical, names
    return None


def meaningful(query: Column) -> Column:
    """Tokens of two characters or more that are no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(query, SEPARATORS), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, F.lower(t)))


def content_terms(query: Column) -> Column:
    return F.array_join(meaningful(query), " ")


def path_like(text: Column) -> Column:
    return text.rlike(r"[.\\/]")


def subject(query: Column) -> Column:
    """An alias set's name, else the first token like a path, else the last of the longest tokens, else the query."""
    return subject_of(meaningful(query), relation(query), normalized(query))


def subject_of(parts: Column, canonical: Column, q: Column) -> Column:
    paths = F.filter(parts, path_like)
    longest = F.reduce(parts, F.lit(""), lambda best, t: F.when(F.length(t) >= F.length(best), t).otherwise(best))
    return F.coalesce(canonical, F.when(F.size(paths) > 0, F.element_at(paths, 1)), F.when(F.size(parts) > 0, longest), q)


def rule_intent(query: Column) -> Column:
    """The first intent whose markers the query has; null if no rule decides."""
    return intent_of(normalized(query), relation(query), subject(query))


def intent_of(q: Column, canonical: Column, about: Column) -> Column:
    out = F.when(path_like(about), "ExactSearch")
    for name in reversed(MARKERS):
        fits = any_of([F.contains(q, F.lit(m)) for m in MARKERS[name]])
        if name == "RelatedSearch":
            fits = fits | canonical.isNotNull()
        out = F.when(fits, name).otherwise(out)
    return out


def routes(log: DataFrame, column: str) -> DataFrame:
    """``log`` with rule_intent, subject and content_terms of a column, as intent, subject and terms. The tokens, the alias set
    and the subject are columns of selects below each other: Spark makes each once a row, as it is used more than once above."""
    q = normalized(F.col(column))
    rows = log.withColumn("_q", q).withColumn("_parts", meaningful(F.col(column)))
    rows = rows.withColumn("_set", relation_of(F.col("_q")))
    rows = rows.withColumn("subject", subject_of(F.col("_parts"), F.col("_set"), F.col("_q")))
    return rows.select(*log.columns, intent_of(F.col("_q"), F.col("_set"), F.col("subject")).alias("intent"), "subject", F.array_join("_parts", " ").alias("terms"))


def routed(query: Column) -> Column:
    """Whether the user interface routes a query as natural language."""
    q = F.lower(query)
    count = F.size(F.filter(F.split(query, r"\s+"), lambda t: t != ""))
    return (count >= 3) | any_of([F.contains(q, F.lit(m)) for m in NATURAL])
