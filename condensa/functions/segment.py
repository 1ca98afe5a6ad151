"""Segments of texts, and what can be extracted from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .text import LEFT, RIGHT, any_sub, any_sub_token, col, let, ltoks, n_sub, ngrams, trimmed

SEGMENT = "array<struct<idx:int,text:string,type:string,compressible:boolean>>"
#: a line that opens or closes code, without its line end
FENCE = r"(?dm)^ *```[^\n]*"
#: the line end of a line and the empty lines after it
EMPTY_LINES = r"\n(?:[ \t\x0B\f\r]*\n)+"


def segments(x, fence_mode: str = "correct") -> Column:
    """Blocks between empty lines and fences, in order, as code or text.

    The text is split at fences, so that every second part is code, and the other
    parts at empty lines. ``correct`` labels what stands between fences as code;
    ``reference`` flips the label at a fence before the block above it is closed, so
    a block that reaches a fence gets the other label.
    """
    block = lambda text, code: F.struct(text.alias("text"), code.alias("code"))
    none = F.array().cast("array<struct<text:string,code:boolean>>")
    flipped = F.lit(fence_mode == "reference")

    def part(n: Column):
        def of(p: Column, i: Column) -> Column:
            last = i == n - 1
            # without the end of the fence's own line, and of the line before the next fence
            body = F.when(i == 0, p).otherwise(p.substr(F.lit(2), F.length(p)))
            inner = F.when(last, body).otherwise(F.regexp_replace(body, r"\n\z", ""))
            code = F.when(F.when(last, p == "").otherwise(body == ""), none).otherwise(F.array(block(inner, last | ~flipped)))
            runs = F.filter(F.transform(F.split(F.concat(F.lit("\n"), inner, F.lit("\n")), EMPTY_LINES, -1), lambda b: F.regexp_replace(b, r"^\n|\n\z", "")), lambda b: b != "")
            reaches = ~last & (inner != "") & ~inner.rlike(r"(?:\A|\n)[ \t\x0B\f\r]*\z") & flipped
            text = let(runs, lambda r: F.transform(r, lambda b, k: block(b, reaches & (k == F.size(r) - 1))))
            return F.when(i % 2 == 1, code).otherwise(text)

        return of

    blocks = let(F.split(F.coalesce(col(x), F.lit("")), FENCE, -1), lambda parts: F.flatten(F.transform(parts, part(F.size(parts)))))
    return F.transform(blocks, lambda b, k: F.struct(k.alias("idx"), b["text"].alias("text"), F.when(b["code"], "code").otherwise("text").alias("type"), (~b["code"]).alias("compressible"))).cast(SEGMENT)


def paragraphs(x) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n\n"), lambda p: trimmed(p)), lambda p: p != "")


def lines(x) -> Column:
    return F.filter(F.split(col(x), "\n"), lambda s: trimmed(s) != "")


def is_code_block(x) -> Column:
    own = lines(x)
    indented = F.size(F.filter(own, lambda s: s.rlike(r"^(?: {4}|\t)")))
    return (indented > F.size(own) * 0.5) | (n_sub(x, lx.CODE_MARKS) >= 2)


def is_list(x) -> Column:
    own = lines(x)
    return F.size(F.filter(own, lambda s: s.rlike(r"^\s*(?:[-*•]|[0-9]+\.)\s"))) > F.size(own) * 0.5


def is_heading(x) -> Column:
    c = trimmed(x)
    return c.rlike("^#") | ((F.length(c) < 100) & F.endswith(c, F.lit(":"))) | ((F.length(c) < 50) & (c == F.upper(c)) & (c != F.lower(c)))


def structure(x) -> Column:
    """Paragraphs with their kind: code, list, heading or paragraph."""
    return F.transform(paragraphs(x), lambda p: F.struct(p.alias("text"), F.when(is_code_block(p), "code").when(is_list(p), "list").when(is_heading(p), "heading").otherwise("paragraph").alias("type")))


def places(x, pattern: str) -> Column:
    """(position, text) of each match of a pattern without groups: the 0-based position in characters."""

    def of(s: Column) -> Column:
        found, parts = s["found"], s["parts"]
        before = F.transform(found, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p)))
        return F.transform(F.arrays_zip(before.alias("position"), found.alias("text")), lambda z: F.struct(z["position"].alias("position"), z["text"].alias("text")))

    c = col(x)
    return let(F.struct(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1).alias("found"), F.split(c, pattern, -1).alias("parts")), of)


FENCED, INLINE = r"```[A-Za-z0-9_+-]*\n[\s\S]*?```", r"`[^`\n]+`"
URL = r"""https?://[^\s<>"']+"""


def code_blocks(x) -> Column:
    """Fenced blocks with their language and position, then inline ones outside of them."""
    c = col(x)
    fenced = F.transform(places(x, FENCED), lambda p: F.struct(p["position"].alias("position"), F.regexp_extract(p["text"], r"^```([A-Za-z0-9_+-]*)", 1).alias("language"), p["text"].alias("code"), F.lit(True).alias("fenced")))
    # a fenced block gives way to as many blanks, so positions stay
    masked = F.array_join(F.transform(F.split(F.regexp_replace(c, f"({FENCED})", "\x01$1\x01"), "\x01"), lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, r"[\s\S]", " ")).otherwise(part)), "")
    inline = F.transform(places(masked, INLINE), lambda p: F.struct(p["position"].alias("position"), F.lit("").alias("language"), p["text"].alias("code"), F.lit(False).alias("fenced")))
    return F.concat(fenced, inline)


def urls(x) -> Column:
    return F.regexp_extract_all(col(x), F.lit(f"({URL})"), 1)


def url_places(x) -> Column:
    return places(x, URL)


def split_words(tokens: Column, words=lx.SPLIT_WORDS, most: int = 10) -> Column:
    """Words of a list that a vocabulary cut in two: neighbouring sub-tokens of over two letters that together are such a word, from the left, each sub-token used once."""

    def step(s: Column, t: Column) -> Column:
        both = F.concat(s["last"], t)
        hit = (F.length(s["last"]) > 2) & (F.length(t) > 2) & F.lower(both).isin(words)
        return F.struct(F.when(hit, "").otherwise(t).alias("last"), F.when(hit, F.concat(s["found"], F.array(both))).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("found"))
    return F.slice(F.aggregate(F.transform(tokens, lambda t: F.trim(t)), start, step, lambda s: s["found"]), F.lit(1), F.lit(most))


def split_sentences(x) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "[.!?]+"), lambda s: trimmed(s)), lambda s: s != "")


def key_words(x, stop=lx.STOP) -> Column:
    """Tokens of letters and digits only, over three characters, no stop word, not all digits."""
    words = F.transform(ltoks(x), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(stop) & ~w.rlike("^[0-9]+$"))


def key_concepts(x, stop=lx.STOP, stems=lx.STEMS) -> Column:
    """Tokens over three characters that are no stop words, and bigrams with one of the stems; repeats stay."""
    words = ltoks(x)
    return F.concat(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(stop)), F.filter(ngrams(words, 2), lambda b: any_sub_token(b, stems)))


def entities(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(x), F.lit(f"{LEFT}([A-Z][a-z]+|[0-9]+){RIGHT}"), 1))


def repeated_phrase(x) -> Column:
    """The first three-word phrase that occurs again, of texts of over ten words."""
    again = let(ngrams(ltoks(x), 3), lambda grams: F.filter(grams, lambda g, i: F.array_position(grams, g) <= i))
    return F.when(F.size(ltoks(x)) > 10, F.get(again, F.lit(0)))


def verbose_phrases(x, verbose=lx.VERBOSE) -> Column:
    low = F.lower(col(x))
    return F.filter(F.array(*map(F.lit, verbose)), lambda p: F.contains(low, p))


def context_hints(prompt, files) -> Column:
    """Language, framework, project and domain guessed from files and words, complexity from the length."""
    own = F.coalesce(col(files), F.array().cast("array<string>"))
    ends = F.transform(own, lambda f: F.lower(F.regexp_extract(f, r"\.([A-Za-z0-9]+)$", 1)))
    has = lambda *e: F.arrays_overlap(ends, F.array(*map(F.lit, e)))
    names = lambda part: F.exists(own, lambda f: F.contains(f, F.lit(part)))
    language = F.when(has("go"), "go").when(has("java"), "java").when(has("js", "ts"), "javascript").when(has("py"), "python").when(has("sql"), "sql")
    framework = F.when(has("tsx", "jsx"), "react").when(has("ipynb"), "notebook")
    project = F.when(names("package.json"), "web").when(names("pyproject"), "library")
    domain = F.when(any_sub(prompt, lx.DOMAINS["finance"]), "finance").when(any_sub(prompt, lx.DOMAINS["support"]), "support").when(names("Dockerfile"), "operations").otherwise("general")
    n = F.length(col(prompt))
    return F.struct(language.alias("language"), framework.alias("framework"), project.alias("project"), domain.alias("domain"), F.when(n < 500, "simple").when(n < 2000, "medium").otherwise("complex").alias("complexity"))
