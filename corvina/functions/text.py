"""Text functions as Catalyst expressions (T1-T9, T12-T18, Q1-Q4): Column in, Column out, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved words that the weighted index discounts.
KEYWORDS = (
    "def class return import from as if elif else for while break continue pass try except finally raise with yield lambda assert global nonlocal "
    "async await function const let var public private protected static void int float bool str self this true false none null undefined"
).split()
#: Signs of an error query, longest first, and of a conceptual one.
ERROR_WORDS = ["assertionerror", "nullpointer", "syntaxerror", "stack trace", "panicked at", "valueerror", "typeerror", "exception", "traceback", "exit code", "keyerror", "segfault", "failure", "failed", "error"]
CONCEPT_WORDS = ["how to", "how do", "why does", "explain", "architecture", "overview", "pattern", "best practice", "usage of", "implementation of"]
#: Concepts in order, with the terms that a query naming them gains.
SYNONYMS = {
    "palindrome": ["is_palindrome", "reversed", "[::-1]"], "binary search": ["binary_search", "bisect", "left", "right", "mid"], "sort": ["sorted", "quicksort", "mergesort", "key"],
    "json": ["json.loads", "json.dumps", "json"], "regex": ["re.search", "re.match", "re.compile", "pattern"], "file": ["open", "read", "readlines", "with open"],
    "matrix": ["grid", "row", "col", "matrix"], "prime": ["is_prime", "primes", "sieve"], "factorial": ["math.factorial", "factorial"], "tree": ["root", "left", "right", "TreeNode"],
    "graph": ["visited", "adj", "dfs", "bfs", "queue"], "jwt": ["token", "verify", "decode", "payload"], "hash": ["hashlib", "sha256", "md5", "hexdigest"],
    "random": ["random.choice", "randint", "sample"], "flatten": ["itertools.chain", "nested", "flatten"], "linked list": ["ListNode", "head", "next"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_identifier(c: Column | str) -> Column:
    """T1. Lower-case parts of a name in order, each once, then the whole name if it has more than one part; only underscores: the name itself."""
    c = col(c)
    return F.when(c == "", F.array().cast("array<string>")).when(c.rlike("^_+$"), F.array(F.lower(c))).otherwise(_parts(c))


def _parts(c: Column) -> Column:
    """Parts of a name that has a letter or digit; each intermediate value is computed once, being bound by a one-element transform."""
    s = F.btrim(c, F.lit("_"))
    for p in ("([0-9])([a-zA-Z])", "([a-zA-Z])([0-9])", "([A-Z]{2,})([A-Z][a-z])", "([a-z0-9])([A-Z])"):
        s = F.regexp_replace(s, p, "$1_$2")
    whole = lambda x: F.array_distinct(F.concat(F.split(x, "_+"), F.array(F.lower(F.btrim(c, F.lit("_"))))))
    return F.get(F.transform(F.array(F.lower(s)), lambda x: F.when(F.contains(x, F.lit("_")), whole(x)).otherwise(F.array(x))), F.lit(0))


def tokenize_code(c: Column | str, split_subtokens: bool = True, min_length: int = 1) -> Column:
    """T2. Terms of a text or query; null gives none."""
    raw = F.filter(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^a-zA-Z0-9_]", " "), " +"), lambda x: F.length(x) >= max(1, min_length))
    if not split_subtokens:
        return F.transform(raw, F.lower)
    out = F.flatten(F.transform(raw, lambda x: F.when(x.rlike("[A-Z_]"), split_identifier(x)).otherwise(F.array(F.lower(x)))))
    return F.filter(out, lambda x: F.length(x) >= min_length) if min_length > 1 else out


def mining_tokens(c: Column | str) -> Column:
    """T3. Terms of the mining index: no sub-splitting."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z_][a-z0-9_]*|[0-9]+"), F.lit(0))


def is_keyword(c: Column | str) -> Column:
    """T4."""
    return col(c).isin(*KEYWORDS)


def fingerprint_text(c: Column | str) -> Column:
    """T5. Comments gone, lower case, words joined by single spaces."""
    bare = F.lower(F.regexp_replace(col(c), r"(?md)(#|//).*$", ""))
    return F.array_join(F.regexp_extract_all(bare, F.lit("[a-z0-9_]+"), F.lit(0)), " ")


def chunk_hash(c: Column | str) -> Column:
    """T6."""
    return F.substring(F.md5(fingerprint_text(c)), 1, 16)


def normalize_content(c: Column | str) -> Column:
    """T7. Line ends as LF, no blanks at line ends, none around the text."""
    t = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), r"(?m)[ \t\x0B\f]+$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def content_hash(c: Column | str, algorithm: str = "sha256") -> Column:
    """T8, T9. Hash of the normalised content by sha256, sha1, md5, sha224, sha384 or sha512."""
    t = normalize_content(c)
    if algorithm == "md5":
        return F.md5(t)
    if algorithm == "sha1":
        return F.sha1(t)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(t, int(algorithm[3:]))
    raise ValueError(f"no hash named {algorithm}")


def sanitize_query(c: Column | str, limit: int | None = None) -> Column:
    """T12. Printable characters, line feeds and tabs; trimmed; cut to limit if one is given."""
    t = F.regexp_replace(col(c), r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.substring(t, 1, limit) if limit else t


def snake_name(c: Column | str) -> Column:
    """T13."""
    w = F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, 5), "_")).otherwise("handler")


# The two snippet forms below.
def hyde_code(c: Column | str, language: str = "python") -> Column:
    """T14. A hypothetical snippet for a query."""
    q = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    n = snake_name(q)
    if language in ("javascript", "typescript", "js", "ts"):
        return F.concat(F.lit("// "), q, F.lit("\nasync function "), n, F.lit("(params) {\n  // Implementation for "), q, F.lit("\n  try {\n    return await execute_"), n, F.lit("(params);\n  } catch (err) {\n    throw err;\n  }\n}"))
    return F.concat(F.lit("def "), n, F.lit('(*args, **kwargs):\n\t"""'), q, F.lit("\n\n\tReturns:\n\t\tResult for "), q, F.lit('.\n\t"""\n\tpass\n'))


def hyde_queries(c: Column | str) -> Column:
    """T15. The query and two hypothetical snippets; none for a blank query."""
    q = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array(q, hyde_code(q), hyde_code(q, "js")))


def expand_query(c: Column | str, cap: int = 5) -> Column:
    """T16. The query with up to cap terms of the concepts that it names; '' for a blank one."""
    c = col(c)
    low = F.lower(c)
    terms = F.flatten(F.array(*[F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]))
    new = F.slice(F.array_distinct(F.filter(terms, lambda t: ~F.contains(low, F.lower(t)))), 1, cap)
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "").when(F.size(new) == 0, c).otherwise(F.concat(c, F.lit(" "), F.array_join(new, " ")))


def _code_lines(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(#|//)"))


def complexity(c: Column | str) -> Column:
    """T17. struct(cyclomatic, depth, lines, branches); operators count only between word characters, as in the model it mirrors."""
    lines = _code_lines(col(c))
    word = r"\b(if|elif|else\s+if|for|while|case|catch|except|&&|\|\||\?)\b"
    branches = F.aggregate(lines, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(word)))
    lead = lambda x: F.regexp_extract(x, r"^(\s*)", 1)
    depth = F.array_max(F.transform(lines, lambda x: F.length(F.regexp_replace(lead(x), "[^\t]", "")) + F.floor(F.length(F.regexp_replace(lead(x), "[^ ]", "")) / 4).cast("int")))
    return F.struct((branches + 1).alias("cyclomatic"), F.coalesce(depth, F.lit(0)).alias("depth"), F.size(lines).alias("lines"), branches.alias("branches"))


def snippet(c: Column | str, start: Column, end: Column) -> Column:
    """T18. Lines start..end (from 1) of a text."""
    return F.array_join(F.slice(F.split(col(c), "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def query_intent(c: Column | str) -> Column:
    """Q1. struct(intent, confidence, symbol, error)."""
    q = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
    low, n = F.lower(q), F.size(F.split(q, r"\s+"))
    none = F.lit(None).cast("string")
    row = lambda intent, conf, symbol=none, error=none: F.struct(F.lit(intent).alias("intent"), F.lit(conf).alias("confidence"), symbol.alias("symbol"), error.alias("error"))
    out = F.when(q == "", row("conceptual", 0.5))
    for k in ERROR_WORDS:
        out = out.when(F.contains(low, F.lit(k)), row("error_debug", 0.9, error=F.lit(k)))
    any_concept = None
    for k in CONCEPT_WORDS:
        hit = F.contains(low, F.lit(k))
        any_concept = hit if any_concept is None else any_concept | hit
    out = out.when(any_concept, row("conceptual", 0.85))
    out = out.when((n == 1) & q.rlike(r"^[a-zA-Z_][a-zA-Z0-9_.]*(\(\))?$"), row("symbol_lookup", 0.95, symbol=q))
    out = out.when((n <= 3) & q.rlike(r"\(|::|->|\."), row("symbol_lookup", 0.85, symbol=q))
    return out.otherwise(row("conceptual", 0.7))


# The words and signs of code.
def syntax_density(c: Column | str) -> Column:
    """Q2. Part of a query's words that look like code."""
    toks = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")
    word = r"(?i)^(def|class|function|return|import|export|from|async|await|const|let|var|if|else|for|while|try|catch|except|raise|throw)$"
    op = r"[_(){}\[\]:;=\->< .&|!@#$%^*]"
    mixed = lambda x: x.rlike("[0-9][a-zA-Z]|[a-zA-Z][0-9]|[A-Z]{2,}[A-Z][a-z]|[a-z0-9][A-Z]")
    hits = F.size(F.filter(toks, lambda x: x.rlike(op.replace(" ", "")) | x.rlike(word) | mixed(x)))
    return F.when(F.size(toks) > 0, hits / F.size(toks)).otherwise(0.0)


def adaptive_weights(c: Column | str, base: float = 0.85, least: float = 0.4) -> Column:
    """Q3. struct(dense, sparse) weights by density."""
    d = F.greatest(F.lit(least), F.least(F.lit(base), F.lit(base) - syntax_density(c) * F.lit(base - least)))
    return F.struct(F.bround(F.round(d, 9), 4).alias("dense"), F.bround(F.round(1 - d, 9), 4).alias("sparse"))


#: Words of a question on structure, and on usage.
STRUCTURAL_WORDS = ["call", "before", "path", "chain", "flow", "reaches"]
USAGE_WORDS = ["where is", "used", "deeplink", "uri", "location", "find use"]


def agent_intent(c: Column | str) -> Column:
    """Q4. structural, usage or semantic; null is semantic."""
    low = F.lower(col(c))
    return F.when(low.rlike("|".join(STRUCTURAL_WORDS)), "structural").when(low.rlike("|".join(USAGE_WORDS)), "usage").otherwise("semantic")
