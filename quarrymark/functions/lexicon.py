"""Closed word classes of English, by part of speech; other modules put their lists together from these."""

from __future__ import annotations

ARTICLES = "a an the".split()
CONJUNCTIONS = "and or but so if because while although whereas though".split()
PREPOSITIONS = (
    "about above across after against along among around at before behind below beneath beside between beyond by down during "
    "for from in inside into near of off on onto out outside over past since through to toward towards under until up upon via "
    "with within"
).split()
PERSONS = (
    "i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves"
).split()
POINTERS = "this that these those".split()
ASKERS = "what when where which who whom whose why how whether".split()
AUXILIARIES = "am is are was were do does did can could will would shall should may might must has have had".split()
VERB_FORMS = "be been being having doing done".split()
ADVERBS = "all also any both each else ever few here just more most much only other own same some such than then there too very".split()

STOPWORDS = sorted({
    *ARTICLES, *CONJUNCTIONS, *PREPOSITIONS, *PERSONS, *POINTERS, *ASKERS, *AUXILIARIES, *VERB_FORMS, *ADVERBS, "as",
})


def phrases(*slots: str) -> list[str]:
    """Every way to fill the slots, alternatives separated by ``|``; an empty alternative leaves its slot out."""
    found = [""]
    for slot in slots:
        found = [f"{head} {word}".strip() for head in found for word in slot.split("|")]
    return found


def longest_first(words: list[str]) -> str:
    """Alternation that prefers the longer phrase."""
    return "|".join(sorted(set(words), key=lambda w: (-len(w.split()), -len(w), w)))
