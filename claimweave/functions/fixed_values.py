"""Fixed values.

Everything in this module is a value the results depend on (word lists, label
maps, thresholds, message texts).  They are stated as plain text and in their
natural order; every operator takes its own list as a parameter, these are
only the defaults.
"""


def _terms(block: str) -> list[str]:
    return [line.strip() for line in block.strip().splitlines() for line in line.split(",") if line.strip()]


# --- fixed values: bias lexicon -------------------------------------------------
LEFT_TERMS = _terms("""
progressive, liberal, democrat, socialism, welfare, regulation, equality, diversity, inclusive, activist,
reform, collective, social justice, worker rights, union, environmental, green new deal, medicare for all,
public option, universal healthcare, planned parenthood, pro-choice, gun control, black lives matter, lgbtq+,
living wage, wealth tax, democratic socialism, defund police, immigration reform, climate action, equity,
labor union, progressive tax, single payer
""")

RIGHT_TERMS = _terms("""
conservative, republican, capitalism, deregulation, traditional, patriot, nationalist, america first,
free market, liberty, freedom, individual, originalist, constitutional, fiscal responsibility,
small government, pro-life, second amendment, gun rights, family values, religious freedom, tough on crime,
national security, military strength, law and order, tax cuts, border security, privatization, tough borders,
free speech, school choice, job creator, limited government
""")

POSITIVE_WORDS = _terms("""
good, great, excellent, positive, nice, correct, true, authentic, legitimate, factual, accurate, verified,
proven, confirmed, valid, right, honest, reliable, trustworthy, credible, beneficial, effective, successful,
remarkable, outstanding, impressive, exceptional, favorable, constructive, commendable, praiseworthy,
admirable, valuable, helpful, promising, encouraging, optimistic, uplifting, breakthrough, innovative,
improving, progress, advance, solution, achievement, triumph, victory
""")

NEGATIVE_WORDS = _terms("""
bad, awful, terrible, negative, wrong, false, fake, hoax, misleading, deceptive, fraudulent, unverified,
untrue, bogus, fabricated, inaccurate, erroneous, dishonest, unreliable, questionable, dubious, suspicious,
harmful, failed, poor, disappointing, inferior, baseless, problematic, flawed, mistaken, exaggerated,
misrepresented, dangerous, misguided, biased, distorted, disinformation, propaganda, conspiracy, corrupt,
scandal, crisis, disaster, catastrophe, failure, damaging
""")

SUBJECTIVE_WORDS = _terms("""
think, believe, feel, opinion, seems, appears, maybe, perhaps, allegedly, supposedly, apparently, rumors,
claiming, reportedly, suggests, suspected, speculated, controversial, debatable, disputed, contentious,
unclear, uncertain, doubtful, likely, unlikely, possible, impossible, claimed, assumes, presumably,
ostensibly, purportedly, argued, contended, insisted, perspective, viewpoint, interpretation, judgment,
assumption, theory, speculation, assertion
""")

EXAGGERATION_WORDS = _terms("""
very, extremely, incredibly, absolutely, definitely, undoubtedly, totally, completely, utterly, entirely,
overwhelmingly, extraordinarily, exceedingly, vastly, tremendously, immensely, profoundly, fundamentally,
drastically, radically, massively, perfectly, endless, unlimited, unparalleled, unprecedented,
revolutionary, groundbreaking, earth-shattering, ever, never, always, impossible, unimaginable,
catastrophic, disastrous, crisis, emergency, tsunami, explosion, skyrocket, plummet, collapse, huge,
enormous, giant, colossal, major, critical, essential, vital
""")

HEDGING_WORDS = _terms("""
may, might, could, possibly, potentially, conceivably, seemingly, somewhat, fairly, relatively, generally,
usually, normally, typically, in general, for the most part, to some extent, to a certain degree,
in a sense, in a way, sort of, kind of, more or less, approximately, roughly, about, around, suggest,
indicate, imply, hint, allude, not necessarily, not entirely, not always, not exactly, almost, nearly
""")

LOADED_PHRASES = _terms("""
so-called, self-proclaimed, alleged, purported, supposed, claimed, radical, extremist, staunch, hardline,
fringe, militant, fanatic, denier, apologist, enabler, elitist, establishment, mainstream,
special interest, scandal-plagued, corrupt, crooked, failed, disgraced, controversial, notorious, infamous,
embattled, beleaguered, far-right, far-left, ultra-conservative, ultra-liberal, conspiracy theorist,
propaganda machine, fake news, deep state, witch hunt, hoax
""")

CLICKBAIT_PHRASES = _terms("""
you won't believe, shocking, mind-blowing, jaw-dropping, game-changing, what happens next, this is why,
here's why, the truth about, the real reason, secret, hidden, revealed, exclusive, breaking, just in, urgent,
warning, must see, must read, need to know, simple trick, one weird trick, doctors hate, this one thing,
stunning, miraculous, unbelievable, will shock you, changed forever, will never be the same, gone wrong,
gone viral, what they don't want you to know, signs you might, top reasons
""")

CITATION_PATTERNS = _terms("""
according to, cited by, reported by, said, source, reference, reports that, stated, quoted, noted,
mentioned by, as per, in the words of
""")

BIAS_WEIGHTS = {
    "political_bias": 0.25,
    "subjectivity_score": 0.20,
    "sentiment_score": 0.15,
    "exaggeration_score": 0.15,
    "loaded_phrase_score": 0.10,
    "clickbait_score": 0.10,
    "citation_density": 0.05,
}

SOURCE_STRENGTH = {"left": 0.7, "right": 0.7, "center": 0.2}

BIAS_ENTITY_PATTERNS = {
    "PERSON": r"[A-Z][a-z]+ (?:[A-Z][a-z]+ )?[A-Z][a-z]+",
    "ORG": r"[A-Z][A-Za-z]+ (?:Company|Corporation|Inc\.?|Ltd\.?|LLC|University|College|Association|Foundation)",
    "GPE": r"United States|U\.S\.|United Kingdom|U\.K\.|Russia|China|Germany|France|[A-Z][a-z]+ (?:City|County|State)",
    # possessive, so that a run of any length takes no stack; each word ends at a boundary, as no shorter one may be tried later
    "OTHER": r"[A-Z][a-z]++(?: [A-Z][a-z]++(?![\p{L}\p{N}_]))++",
}

# --- fixed values: training lexicon (smaller than the bias lexicon) ---------------
TRAIN_POSITIVE = POSITIVE_WORDS[:15]
TRAIN_NEGATIVE = NEGATIVE_WORDS[:15]
TRAIN_SUBJECTIVE = _terms("""
think, believe, feel, opinion, seems, appears, maybe, perhaps, probably, possibly, likely, allegedly,
supposedly, apparently, rumors, claiming, according, sources, reports, suggests, speculates, might, could,
would, should, must, may, can, will
""")
TRAIN_CLICKBAIT = _terms("""
shocking, unbelievable, amazing, surprising, mind-blowing, jaw-dropping, incredible, you won't believe,
never seen before, won't believe, shocked, this is why, secret, trick, easy way, simple trick, how to,
must see, what happens next, this happened, will shock you, simple way, best ever
""")
TRAIN_CLICKBAIT_PHRASES = _terms("you won't believe, this is why, what happens next, will shock you")
TRAIN_EMOTIONAL = _terms("""
angry, sad, happy, joy, fear, scary, terrifying, horrifying, exciting, thrilling, devastating, outrageous,
scandalous, shocking, distressing, heartbreaking, infuriating, frustrated, thrilled, disgusted, appalled,
worried, concerned, anxious, nervous, hopeful, optimistic, pessimistic
""")
TRAIN_EXAGGERATION = _terms("""
always, never, everyone, nobody, all, none, every, only, best, worst, most, least, greatest, perfect,
complete, absolutely, totally, entirely, literally, exactly, definitely, completely, utterly, purely,
thoroughly
""")

# --- fixed values: evidence and verdict --------------------------------------------
CREDIBLE_SOURCES = _terms("""
reuters, associated press, bbc, npr, pbs, nyt, new york times, washington post, guardian, abc, cbs, nbc,
financial times, economist
""")
CONFIRMING_TERMS = _terms("confirm, verify, prove, support, validate, true, correct")
DENYING_TERMS = _terms("deny, debunk, disprove, false, incorrect, hoax, fake")

FEED_ORDER = ("newsapi", "gnews", "mediastack")
FEED_LIMITS = {"newsapi": 20, "gnews": 10, "mediastack": 10}
OTHER_FEED_LIMIT = 10
FEED_MAX_AGE_DAYS = {"newsapi": 30}
FEED_EXCLUDED_CATEGORIES = {"mediastack": ("general", "sports")}
MODES = [  # mode, use knowledge tables, knowledge timeout, article cap
    ("fast", False, 3.0, 5),
    ("balanced", True, 6.0, 8),
    ("accurate", True, 12.0, 15),
]
MAX_CLAIM_CHARS = 1000

# --- fixed values: knowledge facts ---------------------------------------------------
GENERIC_PREDICATES = _terms("related to, involves, mentions, about")
PAIR_PREDICATES = _terms("related to, involves")
CIVIC_SUBJECTS = _terms("election, president, government")
CIVIC_OBJECTS = _terms("election, president, government, vote, fraud")
HEALTH_SUBJECTS = _terms("covid, vaccine, virus")
HEALTH_OBJECTS = _terms("covid, vaccine, virus, health, medical")
PREDICATE_PROPERTIES = {
    "born in": "P19",
    "died in": "P20",
    "founded": "P571",
    "capital": "P36",
    "population": "P1082",
    "spouse": "P26",
    "occupation": "P106",
    "nationality": "P27",
    "author": "P50",
    "director": "P57",
    "located in": "P131",
}

# --- fixed values: typed entity patterns (type, pattern, group kept) ----------------
ENTITY_PATTERNS = [
    ("PERSON", r"[A-Z][a-z]+ [A-Z][a-z]+", 0),
    ("PERSON", r"President [A-Z][a-z]+", 0),
    ("PERSON", r"Dr\. [A-Z][a-z]+", 0),
    ("PERSON", r"Mr\. [A-Z][a-z]+", 0),
    ("PERSON", r"Ms\. [A-Z][a-z]+", 0),
    ("PERSON", r"Mrs\. [A-Z][a-z]+", 0),
    ("ORG", r"[A-Z][A-Za-z]* (Company|Corporation|Inc\.?|Ltd\.?|LLC)", 1),
    ("ORG", r"[A-Z][A-Za-z]+ (University|College)", 1),
    ("ORG", r"University of [A-Z][A-Za-z]+", 0),
    ("ORG", r"[A-Z][A-Z]+", 0),
    ("GPE", r"[A-Z][a-z]+ (City|County|State)", 1),
    ("GPE", r"City of [A-Z][a-z]+", 0),
    ("GPE", r"(United States|U\.S\.|US|USA|UK|China|Russia|Germany|France|Japan)", 1),
    ("DATE", r"(January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4}", 1),
    ("DATE", r"\d{4}", 0),
    ("QUANTITY", r"\d+ (percent|million|billion|trillion)", 1),
    ("QUANTITY", r"\$\d+(\.\d+)? (million|billion|trillion)?", 1),
]
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "DATE", "QUANTITY", "MISC")
ENTITY_STOPWORDS = _terms("""
The, A, An, This, That, These, Those, I, You, He, She, We, They, It, There, Here, Today, Tomorrow, Yesterday,
Monday, Tuesday, Wednesday, Thursday, Friday, Saturday, Sunday
""")

# --- fixed values: labels ---------------------------------------------------------------
LIAR_LABELS = {"pants-fire": 0.0, "false": 0.0, "barely-true": 0.25, "half-true": 0.5, "mostly-true": 0.75, "true": 1.0}
GENERAL_LABELS = {
    "fake": 0.0, "false": 0.0, "pants-fire": 0.0, "barely-true": 0.0,
    "half-true": 0.5, "mostly-true": 1.0, "true": 1.0, "real": 1.0,
}
FEATURE_COLUMNS = _terms("""
text_length, word_count, sentiment_score, subjectivity_score, clickbait_score, emotional_score,
exaggeration_score, inconsistency_score, avg_word_length, avg_sentence_length, readability_score,
unique_word_ratio, title_sentiment_score, title_subjectivity_score, sentiment_discrepancy,
source_credibility
""")

# --- fixed values: contractions that take effect, in the order they are applied ----------
CONTRACTIONS = [
    ("n't", " not"), ("'s", " is"), ("'m", " am"), ("'ll", " will"), ("'d", " would"), ("'ve", " have"), ("'re", " are"),
]

# --- fixed values: English stopwords ---------------------------------------------------------
STOPWORDS = _terms("""
i, me, my, myself, we, our, ours, ourselves, you, you're, you've, you'll, you'd, your, yours, yourself,
yourselves, he, him, his, himself, she, she's, her, hers, herself, it, it's, its, itself, they, them, their,
theirs, themselves, what, which, who, whom, this, that, that'll, these, those, am, is, are, was, were, be,
been, being, have, has, had, having, do, does, did, doing, a, an, the, and, but, if, or, because, as, until,
while, of, at, by, for, with, about, against, between, into, through, during, before, after, above, below, to,
from, up, down, in, out, on, off, over, under, again, further, then, once, here, there, when, where, why, how,
all, any, both, each, few, more, most, other, some, such, no, nor, not, only, own, same, so, than, too, very,
s, t, can, will, just, don, don't, should, should've, now, d, ll, m, o, re, ve, y, ain, aren, aren't, couldn,
couldn't, didn, didn't, doesn, doesn't, hadn, hadn't, hasn, hasn't, haven, haven't, isn, isn't, ma, mightn,
mightn't, mustn, mustn't, needn, needn't, shan, shan't, shouldn, shouldn't, wasn, wasn't, weren, weren't, won,
won't, wouldn, wouldn't
""")

# --- fixed values: verdicts, factors and sentences of a decision -------------------------------
VERDICTS = ["TRUE", "MOSTLY TRUE", "PARTIALLY TRUE", "UNVERIFIED", "MOSTLY FALSE", "FALSE"]
RULE_FACTORS = ["Fact verification results", "Source credibility analysis", "Bias detection"]
TEXT_FACTORS = ["Based on evidence analysis", "Source credibility", "Fact-checking results"]
ERROR_FACTORS = ["Insufficient evidence", "Processing error"]
RULE_SUPPORTED = "The claim appears to be accurate based on factual evidence. Multiple sources confirm key aspects of the claim."
RULE_SUPPORTED_BIASED = "While factually supported, the claim shows significant bias in presentation."
RULE_MIXED = "The claim contains some accurate elements but may be missing context or includes some inaccuracies."
RULE_CONTRADICTED = "The claim is contradicted by available evidence or lacks sufficient supporting evidence."
RULE_STRONG_BIAS = " The claim exhibits strong bias in its presentation."
RULE_MODERATE_BIAS = " The claim shows moderate bias in its framing."

# --- fixed values: the prompt; names in angle brackets are filled in ---------------------------
PROMPT_EXCERPT = """ARTICLE <rank>:
Title: <title>
Source: <source>
Excerpt: <excerpt>

"""
PROMPT = """# CLAIM VERIFICATION TASK

Please analyze the following claim and all available evidence to determine its veracity.

## CLAIM:
"<claim>"
Source: <source>

## EVIDENCE ARTICLES:
<articles>

## FACT-CHECKING RESULTS:
Verification Score: <score> (0-1 scale, higher means more likely to be true)
Explanation: <explanation>

## BIAS ANALYSIS:
Bias Score: <bias> (0-1 scale, higher means more biased)
Bias Indicators:
<indicators>

## YOUR TASK:
Based on all the information above, provide a comprehensive assessment of the claim's veracity. Include:

1. VERDICT: Choose one of [TRUE, MOSTLY TRUE, PARTIALLY TRUE, UNVERIFIED, MOSTLY FALSE, FALSE]
2. TRUST_SCORE: A numerical score between 0 and 1 indicating confidence in the claim's truthfulness
3. EXPLANATION: A detailed explanation of your reasoning
4. CONTRIBUTING_FACTORS: Key factors that influenced your decision

Format your response in JSON as follows:
```json
{
  "verdict": "VERDICT",
  "trust_score": SCORE,
  "explanation": "Your detailed explanation here",
  "contributing_factors": ["Factor 1", "Factor 2", "Factor 3"]
}

Ensure your assessment is balanced, unbiased, and based strictly on the evidence provided."""
