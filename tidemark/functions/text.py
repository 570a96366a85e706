"""Text expressions: sanitising, markup, previews, summaries, escapes and quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.semantics import WS, at, col, js_trim, let, squeeze

# Units of relative time per language.
TIME_UNITS = {
    "ko": ["방금 전", "분 전", "시간 전", "일 전", "주 전", "개월 전", "년 전"],
    "en": ["just now", " min ago", "h ago", "d ago", "w ago", " mo ago", "y ago"],
    "vi": ["vừa xong", " phút trước", " giờ trước", " ngày trước", " tuần trước", " tháng trước", " năm trước"],
    "zh": ["刚刚", "分钟前", "小时前", "天前", "周前", "个月前", "年前"],
    "ja": ["たった今", "分前", "時間前", "日前", "週間前", "ヶ月前", "年前"],
}
PROMO = r"(?i)(t\.me/|discord\.gg/|bit\.ly/|join now|presale)"


def sanitize(x, strict: bool = True) -> Column:
    """Drop control characters; the strict form also drops DEL and the replacement character."""
    extra = r"\x7F�" if strict else ""
    return F.regexp_replace(col(x), rf"[\x00-\x08\x0B\x0C\x0E-\x1F{extra}]", "")


def truncate(x, n: int) -> Column:
    return F.substring(col(x), 1, n)


def title_and_body(text, title_len: int = 200, body_len: int = 2000, keep_whole: bool = False) -> tuple[Column, Column]:
    """First part as title; the body repeats the text only when it is longer than a title.

    ``keep_whole``: a short text is its own body (null when empty).
    """
    t = col(text)
    short = F.nullif(t, F.lit("")) if keep_whole else F.lit(None).cast("string")
    return truncate(t, title_len), F.when(F.char_length(t) > title_len, truncate(t, body_len)).otherwise(short)


def strip_html(x) -> Column:
    return js_trim(F.regexp_replace(col(x), "<[^>]*>", ""))


def strip_board_markup(x) -> Column:
    """Board post markup to text: breaks to newlines, quote links dropped, spoilers masked, entities decoded."""
    x = col(x)
    for pattern, to in [
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)<wbr\s*/?>", ""), (r'(?i)<a[^>]*class="quotelink"[^>]*>[^<]*</a>', ""),
        (r"(?i)<s>[^<]*</s>", "[spoiler]"), (r"<[^>]+>", ""), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'),
        ("&#039;", "'"), ("&[^;]+;", " "),
    ]:
        x = F.regexp_replace(x, pattern, to)
    return js_trim(x)


def clean_text(x) -> Column:
    return squeeze(x)


def ellipsis(x, n: int) -> Column:
    """Cut to ``n`` characters, the last three of them dots."""
    x = col(x)
    return F.when(F.char_length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 3), F.lit("...")))


def last_index(x: Column, ch: str) -> Column:
    """1-based place of the last ``ch``; 0 when absent."""
    p = F.locate(ch, F.reverse(x))
    return F.when(p > 0, F.char_length(x) - p + 1).otherwise(F.lit(0))


def preview(content, n: int = 500) -> Column:
    """Cut at the last sentence end past the middle, else at the last space past 80 %, else hard."""
    def cut(head: Column) -> Column:
        sentence = F.greatest(*[last_index(head, x) for x in ".?!"])
        space = last_index(head, " ")
        return (
            F.when(sentence - 1 > n * 0.5, F.substring(head, F.lit(1), sentence))
            .when(space - 1 > n * 0.8, F.concat(F.substring(head, F.lit(1), space - 1), F.lit("...")))
            .otherwise(F.concat(head, F.lit("...")))
        )

    return let(clean_text(content), lambda c: F.when(F.char_length(c) <= n, c).otherwise(let(F.substring(c, 1, n), cut)))


def fallback_summary(title, content) -> Column:
    """Up to three sentences longer than 20 characters, each within 60; the title when there is none."""
    parts = F.split(F.regexp_replace(col(content), f"[{WS}]+", " "), rf"[.!?][{WS}]+")
    good = F.slice(F.filter(parts, lambda s: F.char_length(js_trim(s)) > 20), 1, 3)
    short = F.transform(good, lambda s: ellipsis(js_trim(s), 60))
    return let(short, lambda g: F.when(F.size(g) == 0, F.array(col(title), F.lit(""), F.lit(""))).otherwise(g))


def split_summary(summary) -> Column:
    """Struct(hook, detail) around the first blank line; without one, all is detail."""
    s = col(summary)
    at_ = F.locate("\n\n", s)
    return F.struct(
        F.when(at_ > 0, F.substring(s, F.lit(1), at_ - 1)).alias("hook"),
        F.when(at_ > 0, F.substring(s, at_ + 2, F.char_length(s))).otherwise(s).alias("detail"),
    )


def join_summary(hook, detail) -> Column:
    h, d = F.nullif(col(hook), F.lit("")), F.nullif(col(detail), F.lit(""))
    return F.when(h.isNotNull(), F.concat(h, F.lit("\n\n"), F.coalesce(d, F.lit("")))).otherwise(d)


def xml_escape(x) -> Column:
    x = col(x)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def like_escape(x) -> Column:
    return F.replace(F.replace(col(x), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def view_count(x) -> Column:
    """'1.2K' to 1200, '3M' to 3000000, plain numbers cut to whole; 0 when it is no number."""
    t = F.upper(js_trim(col(x)))
    n = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")
    big = F.floor(n * F.when(t.endswith("K"), 1000.0).otherwise(1000000.0) + 0.5)
    whole = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long")
    return F.coalesce(F.when(t.endswith("K") | t.endswith("M"), big).otherwise(whole), F.lit(0)).cast("long")


def time_ago(ts, as_of, lang: str = "ko") -> Column:
    """Distance to ``as_of`` in words; each unit rounds down."""
    u = TIME_UNITS[lang]
    s = F.floor((F.unix_micros(at(as_of)) - F.unix_micros(col(ts))) / F.lit(1_000_000.0))
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    d = F.floor(h / 24)
    w, mo, y = F.floor(d / 7), F.floor(d / 30), F.floor(d / 365)

    def say(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(s < 60, F.lit(u[0])).when(m < 60, say(m, u[1])).when(h < 24, say(h, u[2])).when(d < 7, say(d, u[3]))
        .when(w < 4, say(w, u[4])).when(mo < 12, say(mo, u[5])).otherwise(say(y, u[6]))
    )


def quality_flags(x) -> Column:
    """Names of the text problems found, in a fixed order."""
    t = col(x)
    return F.array_compact(F.array(
        F.when(F.char_length(t) < 10, "TOO_SHORT"),
        F.when(t.rlike("(?i)<[a-z]|&[a-z]+;"), "HTML_REMNANT"),
        F.when(t.contains("�"), "BROKEN_UNICODE"),
        F.when(t.rlike(r"(.)\1{20,}"), "SPAM_REPEAT"),
        F.when(t.rlike(PROMO), "SPAM_PROMO"),
    ))
