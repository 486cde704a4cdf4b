"""Text rules as columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that decide a rule.
JAPANESE, KOREAN, HAN = "[぀-ゟ゠-ヿ]", "[가-힯]", "[一-鿿]"
UNCHANGED_PLURALS = ["species"]
LIST_WORDS = ["list", "enumerate", "show all", "what are", "which are", "有哪些", "列出", "清單", "全部"]
EARLIER_HAN, AGAIN_HAN, TONGUES_HAN = ["以上", "上面", "前面", "剛才", "之前的", "上一"], ["重複", "重述", "翻譯", "再說"], ["中文", "英文", "日文", "韓文"]
AGAIN = ["repeat", "translate", "rephrase", "restate", "reword"]
EARLIER = ["above", "previous", "prior", "last reply", "last response", "last answer", "the reply", "the response", "the answer"]
TONGUES = ["chinese", "japanese", "korean", "english", "french", "spanish", "german"]


def singular(word: Column) -> Column:
    """The last word without its plural ending: ies to y, es to e, s to nothing, each with its exceptions."""
    last = F.regexp_extract(word, "[^ ]*$", 0)
    cut = lambda n: F.left(word, F.length(word) - n)
    return (
        F.when(last.isin(UNCHANGED_PLURALS), word)
        .when(last.rlike("ies$") & ~last.rlike("[ea]ies$"), F.concat(cut(3), F.lit("y")))
        .when(last.rlike("es$") & ~last.rlike("[aeo]es$"), cut(1))
        .when(last.rlike("s$") & ~last.rlike("[ius]s$"), cut(1))
        .otherwise(word)
    )


def standard_name(name: Column) -> Column:
    return singular(F.lower(F.trim(name)))


def language_of(text: Column) -> Column:
    """By script: kana, hangul, han, else English; null counts as English."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(JAPANESE), "Japanese").when(t.rlike(KOREAN), "Korean").when(t.rlike(HAN), "Traditional Chinese").otherwise("English")


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike(HAN), F.lit(False))


def is_mirna(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike("^(mir|microrna|let-)")


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def listing_kind(question: Column) -> Column:
    """mirna or mrna if the question asks for a listing of these; else null."""
    q = F.lower(question)
    return F.when(_any(q, LIST_WORDS), F.when(F.contains(q, F.lit("mirna")) | F.contains(q, F.lit("microrna")), "mirna").when(F.contains(q, F.lit("mrna")), "mrna"))


def asks_for_earlier_answer(question: Column) -> Column:
    """Whether a message only wants an earlier answer again, or in another language."""
    q = F.lower(question)
    again_han, tongue_han = _any(question, AGAIN_HAN), _any(question, TONGUES_HAN)
    han = (_any(question, EARLIER_HAN) & (again_han | tongue_han)) | (again_han & tongue_han)
    return F.coalesce(han | (_any(q, AGAIN) & (_any(q, EARLIER) | _any(q, TONGUES))), F.lit(False))


def cited_ids(text: Column) -> Column:
    """Sorted distinct article ids cited as `PMID: n` or `[n]`, of 7 to 10 digits."""
    # fixed values: the two forms of a citation
    named = F.regexp_extract_all(text, F.lit(r"(?i)PMID[:\s]\s*(\d{7,10})"), F.lit(1))
    bracketed = F.regexp_extract_all(text, F.lit(r"\[(\d{7,10})\]"), F.lit(1))
    return F.array_sort(F.array_union(named, bracketed))


def cut_at_sentence(text: Column, limit: int) -> Column:
    """Up to limit characters, back to the last full stop before a space unless that lies before the middle."""
    head = F.left(text, F.lit(limit))
    at = F.length(head) - F.instr(F.reverse(head), " .")  # characters up to and with the full stop
    cut = F.when((F.instr(F.reverse(head), " .") == 0) | (at - 1 < limit // 2), head).otherwise(F.left(head, at))
    return F.when(F.length(text) <= limit, text).otherwise(F.trim(cut))


def token_estimate(text: Column) -> Column:
    """Tokens guessed from words: int(words / 0.75) + 1."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (F.floor(words / F.lit(0.75)) + 1).cast("long")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def link_ids(text: Column) -> Column:
    """Article ids as links: `[n]`, unless right after a letter, and `PMID: n`. What stands in an anchor stays as it is."""
    to = lambda n: f'<a href="https://pubmed.ncbi.nlm.nih.gov/{n}/">'
    parts = F.split(text, r"(?i)(?=<a\s)|(?<=</a>)")
    named = lambda x: F.regexp_replace(x, r"(?i)\b(PMID[:：]?\s*(\d{7,10}))", to("$2") + "$1</a>")
    bare = lambda x: F.regexp_replace(x, r"(?<![A-Za-z])\[(\d{7,10})\]", f"[{to('$1')}$1</a>]")
    linked = F.transform(parts, lambda x: F.when(F.startswith(F.lower(x), F.lit("<a")), x).otherwise(bare(named(x))))
    return F.array_join(linked, "")


def prose(answer: Column) -> Column:
    """The lines of an answer that say something, as an array.

    Out go: a diagram from its fence to the closing fence, a reasoning tag up to its end, rows of tables, numbered headings,
    lines that a bold label opens, everything from the first follow-up question on, and all but one of several empty lines.
    """
    start = F.struct(F.lit("").alias("until"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        t, until, kept = F.trim(line), state["until"], state["kept"]
        opens = F.when(F.startswith(t, F.lit("```mermaid")), "```").when(F.startswith(F.lower(t), F.lit("<thinking")), "</thinking").when(t.rlike(r"^\W*Q\d+\W"), "the end").otherwise("")
        closed_at_once = (opens == "</thinking") & F.contains(F.lower(t), F.lit("</thinking"))
        idle = F.startswith(t, F.lit("|")) | t.rlike(r"^#+ .*\d") | t.rlike(r"^[-*\s]*\*\*[^*]+(:\*\*|\*\*\s*:)") | ((t == "") & ((F.size(kept) == 0) | (F.element_at(kept, -1) == "")))
        words = F.array_join(F.filter(F.split(line, " "), lambda w: w != ""), " ")
        open_now = F.when(until != "", F.when((until != "the end") & F.contains(F.lower(t), until), "").otherwise(until)).otherwise(F.when(closed_at_once, "").otherwise(opens))
        return F.struct(open_now.alias("until"), F.when((until != "") | (opens != "") | idle, kept).otherwise(F.array_append(kept, words)).alias("kept"))

    return F.aggregate(F.split(F.coalesce(answer, F.lit("")), "\n"), start, step, lambda state: state["kept"])


def compressed_answer(text: Column, limit: int = 1400) -> Column:
    """An answer for the history: its prose, cut at a sentence, and a line of the ids it cites (at most 15) if any went missing."""
    t = F.trim(F.array_join(prose(text), "\n"), F.lit(" \n"))
    short = F.when(F.length(t) > limit, F.concat(cut_at_sentence(t, limit), F.lit(" [...]"))).otherwise(t)
    ids = cited_ids(F.coalesce(text, F.lit("")))
    note = F.concat(F.lit("\n[Cited PMIDs: "), F.array_join(F.slice(ids, 1, 15), ", "), F.lit("]"))
    return F.when(F.exists(ids, lambda i: ~F.contains(short, i)), F.concat(short, note)).otherwise(short)


def memory_entry(question: Column, answer: Column) -> Column:
    """A question and its answer in two lines: 120 characters of the one, sentences of up to 250 of the other.

    Of the answer count lines of more than 20 characters, without the marks that open them; notes in brackets do not.
    """
    asked = F.trim(question)
    asked = F.when(F.length(asked) > 120, F.concat(F.rtrim(F.left(asked, F.lit(120))), F.lit("…"))).otherwise(asked)
    lines = F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: (F.length(x) > 20) & (F.left(x, F.lit(1)) != "["))
    said = F.array_join(F.transform(lines, lambda x: F.ltrim(x, F.lit("#*-• "))), " ")
    return F.format_string("Q: %s\nA: %s", asked, cut_at_sentence(said, 250))


# Questions to offer after an answer that has none.
DEFAULT_QUESTIONS = [
    "Which evidence most strongly supports the current conclusion",
    "Which PMIDs provide direct mechanistic evidence",
    "What is the highest-priority hypothesis to validate next",
]
DEFAULT_QUESTIONS_HAN = ["哪些證據最能支持目前的核心結論", "哪些 PMID 提供直接機制證據", "下一步最值得驗證的研究假說是什麼"]


def follow_ups(text: Column, most: int = 3) -> Column:
    """suggested_questions, or for an answer without a first marker the default ones, in Chinese for an answer with Han characters; none for no answer."""
    none = F.array().cast("array<string>")
    usual = F.when(has_han(text), F.array(*map(F.lit, DEFAULT_QUESTIONS_HAN))).otherwise(F.array(*map(F.lit, DEFAULT_QUESTIONS)))
    marked = text.rlike(r"(?i)\bQ1[\]*]{0,3}\s*[:.]")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(marked, suggested_questions(text, most)).otherwise(F.slice(usual, 1, most))


def suggested_questions(text: Column, most: int = 3) -> Column:
    """The follow-up questions of an answer: each stands after a marker (Q and a number, a colon or full stop), up to the next one or the end of its line.

    Only what lies between the first and the last letter or digit counts; from four characters on; the first of equal ones, whatever their case.
    """
    raw = F.regexp_extract_all(text, F.lit(r"(?i)\bQ\d+[\]*]{0,3}\s?[:.]([^\n]*?)(?=[\[*\s]*\bQ\d|\n|$)"), F.lit(1))
    core = F.filter(F.transform(raw, lambda q: F.regexp_extract(q, r"[\p{L}\p{N}].*[\p{L}\p{N})]", 0)), lambda q: F.length(q) > 3)
    low = F.transform(core, F.lower)
    return F.slice(F.filter(core, lambda q, i: F.array_position(low, F.lower(q)) == i + 1), 1, most)
