"""Shapes of text that addresses the reader's software, composed from word lists.

Every shape is one pattern over lower-cased text. Words may be joined by spaces,
hyphens or underscores, or run on; a shape begins and ends at the edge of a word where
its language has such edges. Patterns use neither lookaround nor Unicode word
boundaries, so that other engines read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the shapes, which must be these for the same verdicts.
DROPPING = "ignore disregard forget".split()
WHICH = "all any the your these their".split()
EARLIER = "previous prior above earlier".split()
ORDERS = "instructions? prompts? rules? directives?".split()
DROPPING_ZH = "忽略 无视 不要理会".split()
EARLIER_ZH = "之前 以上 上面 先前 前面 所有 全部".split()
ORDERS_ZH = "指令 提示词? 规则 要求".split()
ROLES = ["you are now", "pretend to be"]
ROLES_ZH = ["你现在是", "从现在开始.{0,4}你是", "扮演(?:一个)?(?:系统|管理员)"]
TOOLS = "web_read web_act web_request web_crawl web_discover web_screenshot web_search web_resolve cred_defaults sys_state sys_guide feed_read doc_parse".split()
SENDING = "--data --data-raw --data-binary --data-urlencode --upload-file".split()
HIDING = ["do not", "don.?t", "never"]
TELLING = "mention tell reveal disclose say show".split()
READERS = ["automated assistant", "automated agent", "automated system", "automated script", "automated bot", "ai assistant", "ai agent"]
TASKS = "fetch include crawl scrape download open visit click summarize".split()
MEASURES = "confidence score rating relevance priority weight".split()
TOPS = "maximum max highest 100".split()

GAP, EDGE, END = r"[\s_-]*", r"(?:^|[^a-z0-9_])", r"(?:[^a-z0-9_]|$)"


def one(words: list[str]) -> str:
    return f"(?:{'|'.join(sorted(words, key=len, reverse=True))})"


def joined(*parts: str) -> str:
    return GAP.join(parts)


def spoken(phrases: list[str]) -> str:
    """One of some phrases, their words joined as ``joined`` does."""
    return one([joined(*p.split()) for p in phrases])


def maybe(words: list[str]) -> str:
    return f"(?:{one(words)}{GAP})?"


PATTERNS = {
    "instruction_override": f"{EDGE}{one(DROPPING)}{GAP}{maybe(WHICH)}{maybe(EARLIER)}{one(ORDERS)}{END}"
    f"|{one(DROPPING_ZH)}(?:{one(EARLIER_ZH)}的?){{1,3}}{one(ORDERS_ZH)}",
    "role_hijack": f"{EDGE}{spoken(ROLES)}{GAP}{one(['a', 'an', 'the', 'my'])}{END}"
    f"|{EDGE}{joined('act', 'as', one(['if', 'though', 'like']))}[\\s_-]+you{END}|{EDGE}{joined('act', 'as', 'my')}{END}|{one(ROLES_ZH)}",
    "tool_call": f"{EDGE}{one(TOOLS)}\\s*\\(",
    "credential_url": r"[a-z][a-z0-9+.-]*://[^\s/<>\"'@]+:[^\s/<>\"'@]+@",
    "exfil_command": f"{EDGE}{one(['curl', 'wget'])}[^a-z0-9_;\\n][^;\\n]{{0,119}}?(?:{one(SENDING)}|-t\\s)",
    "agent_directive": f"{joined('if', 'you', 'are')}{GAP}{maybe(['a', 'an'])}{spoken(READERS)}[^.\\n]{{0,60}}?{one(TASKS)}"
    f"|{EDGE}set{GAP}the{GAP}{maybe(['citation'])}{one(MEASURES)}s?[^.\\n]{{0,16}}?[^a-z0-9_.\\n]{joined('to', one(TOPS))}{END}",
    "hide_from_user": f"{EDGE}{spoken(HIDING)}[^.\\n]{{0,24}}?{one(TELLING)}[^.\\n]{{0,20}}?{joined('to', 'the', 'user')}{END}",
}


def without_code(text: Column) -> Column:
    """``text`` with fenced and inline code blanked."""
    return F.regexp_replace(F.regexp_replace(text, "```[^`]*```", " "), r"`[^`\n]*`", " ")


def hits(text: Column) -> dict[str, Column]:
    """How often each shape occurs in the text outside code."""
    plain = F.lower(without_code(text))
    return {name: F.regexp_count(plain, F.lit(pattern)) for name, pattern in PATTERNS.items()}
