"""Tokenisers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import quoted

# fixed values: one-character stop words, and words of the domain that are kept whole
STOPWORDS = "的之及或與其於者所如各由並而亦均即因此惟另嗣後暨等到自從、，。；：（）「」"

USER_WORDS = (
    "長期照顧 長期照顧服務法 長照 長照服務 長照機構 長照人員 長照體系 長照需要等級 長照特約單位 長照給付對象 失能者 身心失能 家庭照顧者 喘息服務 照顧管理中心 照管中心 "
    "照顧服務員 照顧計畫 照顧組合 給付額度 社區整合型服務中心 住宿式機構 居家式服務 社區式服務 機構住宿式 個人看護者 外籍看護 主管機關 中央主管機關 地方主管機關 "
    "衛生福利部 老人福利 老人福利機構 設立許可 施行細則 復能服務 輔具服務 交通接送 到宅沐浴 日間照顧 評估結果 準用 罰鍰 廢止許可"
).split()


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def longest_of(words: Sequence[str]) -> str:
    """A pattern for the longest of some words at a place, branched by character, so that a place where none begins costs one look."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        heads = sorted(c for c in node if c)
        if not heads:
            return ""
        body = "|".join(quoted(c) + branch(node[c]) for c in heads)
        return f"(?:{body})?" if "" in node else body if len(heads) == 1 else f"(?:{body})"

    firsts = "".join(quoted(c) for c in sorted(tree))
    return f"(?=[{firsts}]){branch(tree)}"


def cjk_tokens(c: Column, user_words: Sequence[str] = ()) -> Column:
    """Longest words of the user's list, other Han text cut at two characters, and runs of other letters and digits, in lower case; stop words left out."""
    listed = longest_of([w for w in user_words if w]) + "|" if any(user_words) else ""
    alone = [w for w in user_words if len(w) == 1]
    single = r"\p{IsHan}" if alone else rf"(?![{STOPWORDS}])\p{{IsHan}}"
    found = F.regexp_extract_all(F.lower(c), F.lit(listed + r"\p{IsHan}{2}|" + single + r"|[\p{L}\p{N}&&[^\p{IsHan}]]+"), 0)
    if not alone:
        return found
    return F.filter(found, lambda x: ~((F.length(x) == 1) & F.lit(STOPWORDS).contains(x)))


def segmented(c: Column) -> Column:
    """The default tokens of texts in any script: Han text by the words of the domain, longest first, and two characters at a time between them; other letters and digits as `words` has them."""
    other = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.when(c.rlike(r"\p{IsHan}"), cjk_tokens(c, USER_WORDS)).otherwise(other)


def token_count(c: Column) -> Column:
    return F.size(words(c))
