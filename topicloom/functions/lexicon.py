"""Word tables of our own. A caller's table, or Spark's lists for other languages, takes their place."""

from __future__ import annotations

STOP_WORDS = """a about after all also am an and any are as at be because been before but by can could did do does for from had
has have he her his i if in into is it its me my no not of on or our out she should so some than that the their them then there
these they this to up us was we were will with would you your""".split()
QUESTION_WORDS = "how what when where which who whom whose why".split()
#: Base forms of verbs that questions on services use; their regular endings follow from rules.
VERBS = """accept access activate add allow apply approve arrive ask assign attach avoid bill block book borrow bring build buy
calculate call cancel carry change charge check choose claim click close collect compare complete confirm connect contact convert
copy create deactivate decline delete deliver deposit differ disable download earn edit enable enroll enter exchange expire extend
fail file fill find fix forget get give grow handle happen help hold import increase install invest invite issue join keep know
learn leave link list load lock log login look lose make manage mean merge modify move need notify offer open order pay pick place
print process protect provide pull purchase receive recharge recover redeem reduce refer refund register reject remove renew repay
replace report request reschedule reset resolve restore return revert schedule see select sell send set share ship show sign solve
start stop submit subscribe support suspend switch take tell track transfer travel trust try turn unblock unlock update upgrade
upload use validate verify view visit wait want withdraw work write""".split()
#: Forms that the rules for endings don't give.
VERB_FORMS = {
    "bought": "buy", "brought": "bring", "built": "build", "chose": "choose", "chosen": "choose", "forgot": "forget", "forgotten": "forget", "found": "find",
    "gave": "give", "given": "give", "got": "get", "gotten": "get", "grew": "grow", "grown": "grow", "held": "hold", "kept": "keep", "knew": "know",
    "known": "know", "left": "leave", "lost": "lose", "made": "make", "meant": "mean", "paid": "pay", "repaid": "repay", "saw": "see", "seen": "see",
    "sent": "send", "shown": "show", "sold": "sell", "taken": "take", "told": "tell", "took": "take", "withdrawn": "withdraw", "withdrew": "withdraw",
    "written": "write", "wrote": "write",
}
#: Adverbs that don't end in -ly, and words that do but are none.
ADVERBS = "again already always ever just never now often once only soon still then together twice yet".split()
NO_ADVERBS = "apply ally anomaly assembly belly bully daily early family fly friendly monthly only rely reply supply weekly yearly july".split()
#: Plurals that the rules for endings don't give, and words that end like plurals but are none.
NOUN_FORMS = {
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "people",
    "analyses": "analysis", "bases": "basis", "crises": "crisis", "criteria": "criterion", "data": "data", "indices": "index", "matrices": "matrix",
}
NO_PLURALS = "access address across always business bus canvas chaos diabetes gas goods is its lens less news perhaps plus process series species status this thus us was yes".split()
#: Detachment rules for plurals: ending, what takes its place. In this order.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
#: Whole-word forms that the endings below don't cover.
CONTRACTIONS = {
    "can't": "cannot", "won't": "will not", "shan't": "shall not", "ain't": "am not", "let's": "let us",
    "that'd": "that had", "how'd": "how did", "where'd": "where did",
}
ENDINGS = {"n't": " not", "'ll": " will", "'ve": " have", "'re": " are", "'m": " am", "'d": " would"}
#: Words whose 's is "is"; other words keep it, as a possessive.
IS_WORDS = "he here how it she that there what when where who why".split()
_SPARK_NAMES = {"da": "danish", "de": "german", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish"}
#: Short tables of our own for languages that Spark has none for: pronouns, particles, conjunctions, prepositions, question words.
_OWN = {
    "ar": "من في على إلى عن مع هذا هذه ذلك التي الذي ما ماذا متى أين كيف لماذا هل هو هي هم أنا أنت نحن أو ثم لا لم لن قد كان كل",
    "hi": "का की के को में से पर और या यह वह ये वे है हैं था थी थे हो मैं हम तुम आप क्या कब कहाँ कैसे क्यों कौन नहीं भी तो ही एक",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あの それ これ どう なぜ いつ どこ だれ 何",
    "zh_tw": "的 了 在 是 我 你 他 她 它 們 有 和 與 或 這 那 就 不 也 都 而 及 著 什麼 怎麼 為什麼 哪裡 誰 何時 嗎 呢",
    "ko": "은 는 이 가 을 를 에 의 와 과 도 로 으로 에서 그 저 나 너 우리 그리고 또는 하지만 무엇 언제 어디 어떻게 왜 누구",
    "bahasa": "yang di ke dari dan atau dengan untuk pada adalah ini itu saya anda kami kita mereka dia tidak bukan akan sudah apa siapa kapan mana bagaimana mengapa",
}
#: Names under which callers ask for the same language.
_SAME = {"zh": "zh_tw", "zh_cn": "zh_tw", "japanese": "ja", "id": "bahasa", "ms": "bahasa", "en_kore": "en"}


def verb_table(bases=VERBS, irregular=None) -> dict[str, str]:
    """Every form of the verbs with its base: the base, -s, -ed and -ing by the rules of spelling, and the irregular ones."""
    out: dict[str, str] = {}
    for b in bases:
        stem = b[:-1] if b.endswith("e") and not b.endswith("ee") else b
        forms = [b, stem + "ing", stem + "ed"]
        if b.endswith("y") and b[-2] not in "aeiou":
            forms += [b[:-1] + "ies", b[:-1] + "ied"]
        elif b.endswith(("s", "x", "z", "ch", "sh", "o")):
            forms.append(b + "es")
        else:
            forms.append(b + "s")
        if len(b) > 2 and b[-1] not in "aeiouwxy" and b[-2] in "aeiou" and b[-3] not in "aeiou":
            forms += [b + b[-1] + "ing", b + b[-1] + "ed"]
        out |= {f: b for f in forms if f not in out}
    return out | (VERB_FORMS if irregular is None else irregular)


def stop_words(lang: str = "en", own: list[str] | None = None) -> list[str]:
    """``own`` if given (with question words for English), else the default table of ``lang``; unknown languages are an error."""
    lang = _SAME.get(lang, lang)
    if own:
        return sorted({*own, *(QUESTION_WORDS if lang == "en" else ())})
    if lang == "en":
        return sorted({*STOP_WORDS, *QUESTION_WORDS})
    if lang in _OWN:
        return sorted(_OWN[lang].split())
    if lang not in _SPARK_NAMES:
        raise ValueError(f"no stop words for {lang!r}: pass a table")
    from pyspark.ml.feature import StopWordsRemover

    return sorted(StopWordsRemover.loadDefaultStopWords(_SPARK_NAMES[lang]))
