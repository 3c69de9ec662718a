"""Column functions over event texts: clipping, noise, intent, redaction, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What hosts inject into transcripts and what tools echo.
NOISE_PREFIXES = ("<environment_context>", "<app-context>", "# agents.md instructions", "<collaboration_mode>")
TOOL_ECHO = r"(?i)^\[(tool_output|tool_result)\]\s*(\[|Script completed|Chunk ID|Process exited|Output:)"
HEARTBEAT = "<heartbeat>"
# CJK range and the token classes of the retrieval index.
CJK = r"[一-鿿]"
WIDE_CJK = r"[\u3400-\u9FFF]"
# Marks of injected text, in any of the first 200 characters of what a user says.
INJECTED_MARKS = ("<environment_context", "<app-context", "# agents.md instructions", "<collaboration_mode", "<heartbeat", "<system-reminder", "[tool_output]", "[tool_result]")
SEGMENT = r"[A-Za-z0-9_./:-]+|[一-鿿]+"
SPACE = r"(?U)\s+"
# Words by which a clause claims a state.
CLAIM = {
    "completed": ("已完成", "完成了", "已修复", "通过", "成功", "已验证", "已经好了"),
    "blocked": ("阻塞", "blocked", "无法", "失败", "报错", "未能", "超时"),
    "in_progress": ("进行中", "继续", "下一步", "正在", "待处理", "todo"),
}
NEGATED = (
    r"(?:尚未|未曾|没有|并未|不能|无法|未能|不曾|还没|没能|未|没|不)(?:全部|完全|全部都|能|够)?(?:完成|通过|成功|修复|验证|交付)"
    r"|\b(?:not|never|hasn't|haven't|isn't|wasn't|cannot|can't|didn't)\s+(?:yet\s+)?(?:been\s+)?"
    r"(?:complete[ds]?|pass(?:ed)?|succeed(?:ed)?|fix(?:ed)?|verified|delivered)\b"
)
# Credential shapes and the mark that replaces them.
MARK = "[redacted:credential]"
CREDENTIALS = (
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|\z)", MARK),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b", MARK),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/=-]{12,}", "$1" + MARK),
    (r"(?i)((?:[\w.-]*(?:api[_-]?key|secret|access[_-]?token|password|passwd)|密码)\s*[\"']?\s*[:=]\s*[\"']?)([^\s\"'`,;&<>]{8,})", "$1" + MARK),
    (r"(https?://[^\s/:@]+:)[^\s/@]+(@)", "$1" + MARK + "$2"),
)
STRICT_CREDENTIALS = ((r"(?i)(\btoken\s*[:=]\s*[\"']?)[A-Za-z0-9._-]{16,}", "$1" + MARK),)
# Path-like tokens and file extensions of work products.
FILES = (
    r"(?<![\w./-])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"
    r"|(?<![\w./-])[A-Za-z0-9_.-]+\.(?:py|ts|tsx|js|jsx|json|md|yaml|yml|html|css|sql)(?![\w.-])"
)


def blank_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(blank_as_empty(text), SPACE, " "))


def clip(text: Column, limit: int, keep: int | None = None) -> Column:
    """Squeezed text cut to ``keep`` (default ``limit``) code points and an ellipsis where longer than ``limit``."""
    one = squeeze(text)
    return F.when(F.char_length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit if keep is None else keep), F.lit("…")))


def useful(text: Column) -> Column:
    """Trimmed text, or '' for blanks, injected context, heartbeats and tool echoes."""
    t = F.trim(F.regexp_replace(blank_as_empty(text), r"(?U)^\s+|\s+$", ""))
    low = F.lower(t)
    noise = low.contains(HEARTBEAT) | t.rlike(TOOL_ECHO)
    for p in NOISE_PREFIXES:
        noise = noise | low.startswith(p)
    return F.when(noise, "").otherwise(t)


def intent(text: Column, limit: int = 200) -> Column:
    """Squeezed user intent, '' for injected text and for texts too short to mean something."""
    t = squeeze(text)
    head = F.lower(F.substring(t, 1, limit))
    noise = F.lit(False)
    for mark in INJECTED_MARKS:
        noise = noise | head.contains(mark)
    enough = (F.char_length(t) >= 3) | (F.regexp_count(t, F.lit(WIDE_CJK)) >= 2)
    return F.when(enough & ~noise, F.substring(t, 1, limit)).otherwise("")


def redact(text: Column, strict: bool = False) -> Column:
    """Credentials masked. ``strict`` adds assignments of long tokens; clip only afterwards."""
    for pattern, mark in CREDENTIALS + (STRICT_CREDENTIALS if strict else ()):
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_all(texts: Column, strict: bool = False) -> Column:
    return F.transform(texts, lambda t: redact(t, strict))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(blank_as_empty(text)) + 3) / 4)).cast("long")


def latin_tokens(segment: Column) -> Column:
    """A word run's token and, for plurals, its singular."""
    w = F.lower(F.regexp_replace(segment, r"^[._:/-]+|[._:/-]+$", ""))
    plural = (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.when(F.length(w) < 2, F.array().cast("array<string>")).when(plural, F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w))


def cjk_tokens(segment: Column) -> Column:
    """Single characters, then bigrams."""
    n = F.length(segment)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(segment, i, F.lit(1)))
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(segment, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, two)


def tokenize(text: Column, segment: str = SEGMENT) -> Column:
    """array<string>: lower-cased word runs with singulars, CJK characters and bigrams, repeats kept."""
    found = F.regexp_extract_all(blank_as_empty(text), F.lit(segment), F.lit(0))
    return F.flatten(F.transform(found, lambda s: F.when(s.rlike("^" + CJK), cjk_tokens(s)).otherwise(latin_tokens(s))))


UNICODE_SEGMENT = r"(?U)[\w./:-&&[^一-鿿]]+|[一-鿿]+"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def clause_status(clause: Column) -> Column:
    """State that one lower-cased clause claims; null where it claims none. Negation comes first."""
    negated = F.when(clause.rlike("失败|无法|阻塞|未通过|未能|不能|fail|block|cannot"), "blocked").otherwise("in_progress")
    done = contains_any(clause, CLAIM["completed"])
    later = clause.rlike(r"计划|准备|将会|将要|待完成|待验证|如果|\b(?:plan|planned|will|would|if|todo)\b")
    return (
        F.when(clause.rlike(NEGATED), negated)
        .when(clause.rlike(r"阻塞|无法|失败|报错|未能|超时|\b(?:blocked|failed|failure|timeout)\b"), "blocked")
        .when(later & done, "in_progress")
        .when(done | clause.rlike(r"\b(?:completed|passed|verified|delivered|fixed)\b"), "completed")
        .when(contains_any(clause, CLAIM["in_progress"]), "in_progress")
    )


def last_claim(text: Column) -> Column:
    """State of the last deciding clause of a text; null where none decides."""
    clauses = F.split(F.lower(text), "[。！？!?\n；;]")
    stated = F.filter(F.transform(clauses, clause_status), lambda s: s.isNotNull())
    return F.element_at(F.when(F.size(stated) > 0, stated), -1)


def claimed_status(texts: Column) -> Column:
    """State of the latest deciding clause of an ordered array of texts; 'in_progress' without one."""
    stated = F.filter(F.transform(texts, last_claim), lambda s: s.isNotNull())
    return F.coalesce(F.element_at(F.when(F.size(stated) > 0, stated), -1), F.lit("in_progress"))


def file_tokens(text: Column) -> Column:
    return F.regexp_extract_all(blank_as_empty(text), F.lit("(?U)" + FILES), F.lit(0))


def spread(items: Column, limit: int) -> Column:
    """At most ``limit`` items at evenly spaced ranks, first and last included (half rounds to even)."""
    n = F.size(items)
    if limit <= 1:
        return F.slice(items, F.greatest(n, F.lit(1)), F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(limit - 1))).cast("int"))
    return F.when(n <= limit, items).otherwise(F.transform(F.array_distinct(at), lambda i: F.element_at(items, i + 1)))


def first_per(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no earlier item has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)
