"""Small word lists of our own, used where no lexicon is given."""

from __future__ import annotations

STOP_WORDS = tuple("a about after all also am an and any are as at be because been before being both but by can did do does doing down each few for from further had has have having he her here hers him his how i if in into is it its just me more most my of off on once only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())

VERBS = tuple("like love want need know think see feel believe care go come work sleep eat drive call wait help understand remember watch read listen play stop start mind agree trust enjoy hate find get make take give say tell".split())

#: Pairs of opposites; each word of a pair stands for the other one under a negation.
OPPOSITES = (
    ("good", "bad"), ("happy", "sad"), ("fast", "slow"), ("hot", "cold"), ("easy", "difficult"), ("strong", "weak"), ("rich", "poor"), ("clean", "dirty"),
    ("kind", "cruel"), ("right", "wrong"), ("safe", "dangerous"), ("cheap", "expensive"), ("early", "late"), ("light", "dark"), ("new", "old"), ("nice", "nasty"),
)
ANTONYMS = {a: b for a, b in OPPOSITES} | {b: a for a, b in OPPOSITES}

FILLERS = ("so", "as", "very", "such", "that", "much", "the", "a")

COLLOQUIAL = {"u": "you", "r": "are", "gr8": "great", "thx": "thanks", "pls": "please", "omg": "oh my god", "idk": "i do not know", "btw": "by the way", "gonna": "going to", "wanna": "want to", "cuz": "because", "b4": "before", "2moro": "tomorrow"}
