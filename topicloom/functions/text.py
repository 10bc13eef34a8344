"""Text functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions import lexicon

NON_WORD = r"[^\p{L}\p{N}_]+"
#: Fixed values, for equal results: marks that become spaces, and those that go with the spaces after them before all else.
ANALYZER_MARKS = "?.!:,،؟<>/;{}[]()\\|_-+=~`"
PRE_CLEAN = r"[-,.;@#?!&$/]+ *"


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _expanded_once(text: Column) -> Column:
    for short, full in lexicon.CONTRACTIONS.items():
        text = F.regexp_replace(text, rf"\b{short}\b", full)
    for ending, full in lexicon.ENDINGS.items():
        text = F.regexp_replace(text, rf"([a-z]){ending}\b", f"$1{full}")
    return F.regexp_replace(text, rf"\b({'|'.join(lexicon.IS_WORDS)})'s\b", "$1 is")


def expand_contractions(text: Column) -> Column:
    """``isn't`` to ``is not`` and so on in lower-case text, whole words only; twice, for double contractions, where an apostrophe is left."""
    short = lambda t: F.contains(t, F.lit("'"))
    again = lambda t: F.when(short(t), _expanded_once(t)).otherwise(t)
    return F.when(short(text), let(_expanded_once(text), again)).otherwise(text)


def normalize(text: Column, lang: str = "en") -> Column:
    """Lower case; for English also expanded contractions, and runs of other than letters, digits and _ as one space."""
    low = F.lower(text)
    return F.regexp_replace(expand_contractions(low), NON_WORD, " ") if lang == "en" else low


def analyzer_normalize(text: Column, lang: str = "en") -> Column:
    """The analyzer's token list: punctuation to spaces, lower case, contractions, split."""
    plain = F.lower(F.regexp_replace(text, PRE_CLEAN, " "))
    if lang == "en":
        plain = F.translate(expand_contractions(plain), ANALYZER_MARKS, " " * len(ANALYZER_MARKS))
    return tokens(plain)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def words(text: Column) -> Column:
    """Words and single marks, so that a mark next to a word doesn't hide it."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), 1)


def among(word: Column, table) -> Column:
    """Whether a word is in a Python collection; more than ten words make a hash set."""
    return word.isin(*table) if len(table) else F.lit(False)


def without(words: Column, stop) -> Column:
    """Drops stop words and keeps repeats."""
    return F.filter(words, lambda x: ~among(x, [*stop]))


def valid_words(words: Column) -> Column:
    return F.filter(words, lambda x: F.length(x) > 1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _runs(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words; none if there are fewer."""
    return let(words, lambda w: _runs(w, n))


def ngrams_up_to(words: Column, most: int = 4) -> Column:
    return let(words, lambda w: F.flatten(F.array(*[_runs(w, n) for n in range(1, most + 1)])))


def chunks(words: Column, boundary) -> Column:
    """Maximal runs of words between boundary words and marks, as arrays of words."""
    cut = lambda w: among(w, [*boundary]) | ~w.rlike(r"[\p{L}\p{N}_]")
    marked = F.array_join(F.transform(words, lambda w: F.when(cut(w), F.lit("|")).otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda c: tokens(c)), lambda c: F.size(c) > 0)


def verb_words(words: Column, verbs, adverbs=lexicon.ADVERBS, no_adverbs=lexicon.NO_ADVERBS) -> Column:
    """``array<struct<i,term>>``: verb forms, and the adverbs that stand before one (any number of adverbs, then a verb), with their places."""
    adverb = lambda w: (among(w, [*adverbs]) | (F.endswith(w, F.lit("ly")) & (F.length(w) > 4))) & ~among(w, [*no_adverbs])
    kinds = F.array_join(F.transform(words, lambda w: F.when(among(w, [*verbs]), "V").when(adverb(w), "A").otherwise("x")), "")
    # an adverb that leads to a verb becomes a
    led = let(F.regexp_replace(kinds, "A(?=A*V)", "a"), lambda k: F.transform(words, lambda w, i: F.struct(i.alias("i"), F.when(F.substring(k, i + 1, F.lit(1)).isin("V", "a"), w).alias("term"))))
    return F.filter(led, lambda x: x.term.isNotNull())


def single_word_tag(question: Column, stop) -> Column:
    """The only word of a question that is no stop word, else null."""
    plain = F.lower(F.regexp_replace(F.trim(question), r"\?$", ""))
    left = F.filter(F.array_distinct(tokens(plain)), lambda x: ~among(x, [*stop]))
    return F.when(F.size(left) == 1, left[0])


def padded(text: Column) -> Column:
    """Doubled separators and outer spaces, so that adjacent words never share one."""
    return F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))


def parse_term(raw: Column) -> Column:
    """``[**|!!]name[/synonym]*[:trait]`` as struct(key, name, usage, trait, synonyms).

    ``key`` is the name with its mark: nodes of one key are one. Only the whole term is trimmed. More than
    one colon is null.
    """
    halves = F.split(F.trim(raw), ":")
    names = F.split(halves[0], "/")
    usage = F.when(F.startswith(names[0], F.lit("**")), "mandatory").when(F.startswith(names[0], F.lit("!!")), "organizer").otherwise("default")
    name = F.when(usage == "mandatory", F.replace(names[0], F.lit("**"), F.lit(""))).when(usage == "organizer", F.replace(names[0], F.lit("!!"), F.lit(""))).otherwise(names[0])
    own = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    term = F.struct(names[0].alias("key"), name.alias("name"), usage.alias("usage"), F.get(halves, F.lit(1)).alias("trait"), F.array_sort(F.array_distinct(own)).alias("synonyms"))
    return F.when(F.size(halves) <= 2, term)


def clean_term(raw: Column) -> Column:
    """Words of a term for the synonym generator: object names, parts between slashes up to a colon, without outer * and !."""
    name = F.when(F.startswith(raw, F.lit("{")), F.coalesce(F.get_json_object(raw, "$.name"), raw)).otherwise(raw)
    return F.transform(F.split(name, "/"), lambda x: F.regexp_replace(F.regexp_replace(F.split(x, ":")[0], r"^\*+|\*+$", ""), "^!+|!+$", ""))
