"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of user interfaces that mark a short line as noise.
NOISE = ("Log Console", "Skip To Main Content", "Account", "Settings", "Logout", "Submit Search", "Home", "Contents", "Index", "Glossary", "Browse", "Community", "Search Filters", "Previous", "Next", "Create Profile", "Username *", "Email Address *", "Email Notifications", "Submit", "Cancel", "Filter:", "returned", "result(s)")
#: Strings that an input must not hold.
DANGEROUS = ("<script", "javascript:", "onload=", "onerror=", "SELECT", "DROP", "INSERT", "UPDATE", "DELETE", "../", "..\\", "/etc/", "C:\\", "eval(", "exec(", "system(", "shell_exec(")
#: Terms of a query and what is added for each, in order.
EXPANSIONS = (
    ("function", "function method procedure"),
    ("class", "class object type"),
    ("api", "api interface endpoint"),
    ("database", "database db data storage"),
    ("server", "server backend service"),
    ("client", "client frontend application"),
    ("install", "install setup configure deployment"),
    ("config", "config configuration settings"),
    ("tutorial", "tutorial guide example walkthrough"),
    ("error", "error exception bug issue"),
    ("performance", "performance optimization speed"),
    ("security", "security authentication authorization"),
    ("documentation", "documentation docs guide reference"),
    ("example", "example sample code snippet"),
    ("how to", "how to tutorial guide steps"),
)


def any_of(c: Column, parts, lower: bool = False) -> Column:
    """Whether a text holds one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | (F.lower(c).contains(p.lower()) if lower else c.contains(p))
    return out


def tokens(c: Column) -> Column:
    """Lower-case words between white space; of null or blank text, none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Lines without user-interface noise, very short lines and lines of signs."""
    lines = F.transform(F.split(c, "\n"), trim_ws)

    def good(x: Column) -> Column:
        signs = F.length(F.regexp_replace(x, r"[\p{L}\p{N}\s]", ""))
        return (F.length(x) >= 3) & ~(any_of(x, NOISE) & (F.length(x) < 100)) & (signs / F.length(x) <= 0.5)

    return F.array_join(F.filter(lines, good), "\n")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


def section_path(hierarchy: Column, order: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(hierarchy, " > "), F.lit("")), F.concat(F.lit("Chunk "), order))


def hierarchy(page_title: Column, section_title: Column) -> Column:
    page = F.substring(page_title, 1, 100)
    more = F.when((section_title != "") & (section_title != page), section_title)
    return F.array_compact(F.array(page, more))


def content_type(text: Column, level: Column) -> Column:
    return F.when(text.contains("<code>") | text.contains("<pre>"), "code").when(level == 1, "heading").otherwise("text")


def looks_like_code(text: Column) -> Column:
    return text.rlike(r"\{[^}]*\}") | text.rlike(r"function\s*\(") | text.rlike(r"class\s+\w+") | text.rlike(r"def\s+\w+")


def safe_file_name(name: Column) -> Column:
    last = F.element_at(F.split(F.element_at(F.split(name, "/"), -1), r"\\"), -1)
    clean = F.translate(last, '<>:"|?*\x00', "________")
    ext = F.element_at(F.split(clean, r"\."), -1)
    stem = F.regexp_replace(clean, r"\.[^.]*$", "")
    short = F.when(F.instr(clean, ".") > 0, F.concat(F.substring(stem, 1, 250), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))).otherwise(F.substring(clean, 1, 250))
    return F.when(F.length(clean) > 255, short).otherwise(clean)


def safe_input(text: Column, most: int = 1000) -> Column:
    return (F.length(text) <= most) & ~any_of(text, DANGEROUS, lower=True)


def strong_password(p: Column) -> Column:
    return (F.length(p) >= 8) & p.rlike("[A-Z]") & p.rlike("[a-z]") & p.rlike("[0-9]") & p.rlike(r"""[!@#$%^&*(),.?":{}|<>]""")


def expand_query(q: Column) -> Column:
    """Terms met in the growing query add their expansions, in order."""
    out = trim_ws(F.lower(q))
    steps = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("more")) for a, b in EXPANSIONS])
    return F.aggregate(steps, out, lambda acc, e: F.when(acc.contains(e["term"]), F.concat(acc, F.lit(" "), e["more"])).otherwise(acc))


def overlap_tail(text: Column, n: int) -> Column:
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.array_join(F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w), " ")


def parse_relevance(reply: Column) -> Column:
    """The first word as a number from 0 to 10; 5 if it is none."""
    first = F.element_at(F.split(F.split(trim_ws(reply), r"\s+")[0], "/"), 1)
    number = F.when(first.rlike(r"^[+-]?[0-9.]+$"), first.try_cast("double"))
    return F.when(number.isNull(), 5.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)))


def citations(response: Column) -> Column:
    """Cited sources in the order of the three patterns, each once."""
    found = [F.regexp_extract_all(response, F.lit(p), F.lit(1)) for p in (r"\[(\d+)\]", r"\[Source (\d+)\]", r"\(Source:\s*([^)]+)\)")]
    return F.array_distinct(F.concat(*found))


def invalid_citations(cited: Column, n_sources: Column) -> Column:
    """Numeric citations of sources that do not exist."""
    return F.filter(cited, lambda c: c.rlike(r"^\s*\d+\s*$") & ((c.try_cast("int") < 1) | (c.try_cast("int") > n_sources)))


def expansions_of(response: Column, n: int) -> Column:
    """Queries in a model's reply: numbered or bulleted lines of 5 to 200 characters; else parts between stops."""
    #: What marks a line that is no query.
    skip = ("alternative", "query:", "queries:", "example:", "original:", "here are", "generated")
    lines = F.filter(F.transform(F.split(trim_ws(response), "\n"), trim_ws), lambda x: (x != "") & ~any_of(x, skip, lower=True))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\d+[.)]\s*", ""), r"^[-•*]\s*", ""), r"""^["']+|["']+$""", ""))
    fits = lambda x: F.length(x).between(5, 200)
    out = F.slice(F.filter(bare, fits), 1, n)

    def cut(by: str) -> Column:
        return F.slice(F.filter(F.transform(F.split(response, by), lambda x: F.regexp_replace(trim_ws(x), r"""^["']+|["']+$""", "")), fits), 1, n)

    for by in ("\n", r"\.", ";"):
        out = F.when(F.size(out) > 0, out).otherwise(cut(by))
    return out


def progress_band(p: Column, start: float, end: float) -> Column:
    return F.lit(start) + (F.lit(end) - F.lit(start)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def batch_size(free_gb: Column) -> Column:
    return F.when(free_gb >= 8, 32).when(free_gb >= 4, 16).when(free_gb >= 2, 8).when(free_gb >= 1, 4).otherwise(2)


def numbered_references(response: Column, titles: Column) -> Column:
    """The response with a list of the sources that it cites by number."""
    numbers = F.array_sort(F.filter(F.transform(citations(response), lambda c: c.try_cast("int")), lambda i: i.isNotNull() & (i >= 1) & (i <= F.size(titles))))
    lines = F.transform(numbers, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.get(titles, i - 1)))
    return F.when(F.size(numbers) > 0, F.concat(response, F.lit("\n\n## References\n"), F.array_join(lines, "\n"))).otherwise(response)


def chunk_with_header(title: Column, chunk: Column, part: Column, parts: Column) -> Column:
    """A chunk below its heading, which tells its part where a section has several."""
    number = F.when(parts > 1, F.concat(F.lit(" (Part "), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("# "), title, number, F.lit("\n\n"), chunk)


def event_stream_text(body: Column) -> Column:
    """The reply in a stream of ``data:`` lines, whose deltas follow each other up to ``[DONE]``; lines that are no JSON add nothing."""
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("data: ")), lambda x: F.substring(x, F.lit(7), F.length(x)))
    return F.array_join(F.array_compact(F.transform(lines, lambda x: F.get_json_object(x, "$.choices[0].delta.content"))), "")


def json_lines_text(body: Column) -> Column:
    """The reply in lines of JSON, each with a part of it as ``response``."""
    return F.array_join(F.array_compact(F.transform(F.split(body, "\n"), lambda x: F.get_json_object(x, "$.response"))), "")


def merged_metadata(base: Column, section: Column) -> Column:
    """Both maps in one; where they share a key, the section's value stands."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(section), k)), section)


def sentence_boundary(text: Column, target: Column | int) -> Column:
    """The end of the sentence (a full stop, ! or ? before white space or the end) nearest to a place, the earlier one on ties; null without any."""
    target = target if isinstance(target, Column) else F.lit(target)
    before, after = F.substring(text, F.lit(1), target), F.substring(text, target + 1, F.length(text))
    # a sign at the cut ends a sentence only if what follows allows it
    left = F.length(F.regexp_extract(F.concat(before, F.substring(text, target + 1, F.lit(1))), r"(?s)^(.*[.!?])(?=\s|$)", 1))
    left = F.when(left > target, F.lit(0)).otherwise(left)
    right = F.length(F.regexp_extract(after, r"(?s)^(.*?[.!?])(?=\s|$)", 1))
    lo, hi = F.when(left > 0, left), F.when(right > 0, target + right)
    return F.when(hi.isNull() | (target - lo <= hi - target), lo).otherwise(hi)


#: What an error message holds, in this order, and the kind that it tells.
ERROR_KINDS = (
    (("max_tokens", "maximum context length", "context length"), "context"),
    (("out of memory",), "memory"),
    (("model not found", "no such file"), "model"),
    (("timeout",), "timeout"),
)
#: Kinds by status where the body tells nothing.
STATUS_KINDS = ((400, "bad request"), (404, "endpoint"), (500, "internal"), (503, "unavailable"))


def service_error(body: Column, status: Column) -> Column:
    """A service's error as a struct of kind and detail: by the message in its JSON body, else by its status with the first 200 characters of the body."""
    error = F.get_json_object(F.when(F.is_valid_utf8(body), body), "$.error")
    message = F.coalesce(F.get_json_object(error, "$.message"), error)
    kind = F.lit("other")
    for parts, name in reversed(ERROR_KINDS):
        # the first kind is told by case as well
        kind = F.when(any_of(message, parts, lower=name != "context"), name).otherwise(kind)
    by_status = F.concat(F.lit("http "), status.cast("string"))
    for code, name in STATUS_KINDS:
        by_status = F.when(status == code, name).otherwise(by_status)
    told = message.isNotNull()
    return F.struct(F.when(told, kind).otherwise(by_status).alias("kind"), F.when(told, message).otherwise(F.substring(F.coalesce(body, F.lit("")), 1, 200)).alias("detail"))
