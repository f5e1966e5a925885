"""Phrases, class fragments, labels and default word lists."""

from __future__ import annotations

# A text that contains one of these is page furniture, not content.
IGNORED_PHRASES = [
    "login", "sign in", "subscribe", "advertisement", "cookie", "privacy policy",
    "terms of service", "all rights reserved", "copyright", "newsletter",
    "skip to content", "read more", "share this", "follow us", "menu",
    "search bar", "close", "toggle navigation", "sidebar", "footer",
]

# Class or id fragments of navigation, advertising and widgets.
JUNK_FRAGMENTS = [
    "navbar", "nav-bar", "main-nav", "main-menu", "site-nav",
    "footer", "sidebar", "breadcrumb", "pagination",
    "social", "share", "comment", "ad-", "advert", "promo", "popup", "modal",
    "cookie", "widget",
]

# Container tags whose content is junk, and title-like class words.
JUNK_CONTAINERS = ["nav", "footer", "aside"]
TITLE_WORDS = ["title", "headline", "heading", "story", "article", "card", "post", "entry", "news"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# Entity labels and the category each is shown under.
LABEL_CATEGORY = {
    "PERSON": "People",
    "ORG": "Organizations",
    "GPE": "Locations",
    "LOC": "Locations",
    "DATE": "Dates",
    "MONEY": "Money",
}

# Sentiment labels with their badges, in display order.
SENTIMENT_BADGES = {"Positive": "🟩 Positive", "Neutral": "⬜ Neutral", "Negative": "🟥 Negative"}

# Default stop words. A caller that needs another vectoriser's list passes it in.
STOP_WORDS = [
    "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "could", "do", "down", "during", "each", "few", "for", "from", "further", "had", "has",
    "have", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "if", "in",
    "into", "is", "it", "its", "itself", "me", "more", "most", "my", "myself", "no", "nor", "not",
    "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out",
    "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their",
    "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself", "yourselves",
]

# Default lexicon: word, polarity, subjectivity, intensity. Rows with intensity other than 1 scale
# the word after them. It is small on purpose; a caller passes its own rows.
LEXICON = [
    ("absolutely", 0.2, 0.9, 1.3),
    ("amazing", 0.6, 0.9, 1.0),
    ("awful", -1.0, 1.0, 1.0),
    ("bad", -0.7, 0.67, 1.0),
    ("beautiful", 0.85, 1.0, 1.0),
    ("best", 1.0, 0.3, 1.0),
    ("better", 0.5, 0.5, 1.0),
    ("boring", -1.0, 1.0, 1.0),
    ("disgusting", -1.0, 1.0, 1.0),
    ("excellent", 1.0, 1.0, 1.0),
    ("extremely", -0.1, 1.0, 1.4),
    ("fine", 0.4, 0.5, 1.0),
    ("good", 0.7, 0.6, 1.0),
    ("great", 0.8, 0.75, 1.0),
    ("happy", 0.8, 1.0, 1.0),
    ("hate", -0.8, 0.9, 1.0),
    ("horrible", -1.0, 1.0, 1.0),
    ("idiot", -0.8, 0.8, 1.0),
    ("interesting", 0.5, 0.5, 1.0),
    ("love", 0.5, 0.6, 1.0),
    ("new", 0.14, 0.45, 1.0),
    ("nice", 0.6, 1.0, 1.0),
    ("only", 0.0, 1.0, 1.1),
    ("pathetic", -1.0, 1.0, 1.0),
    ("poor", -0.4, 0.6, 1.0),
    ("really", 0.2, 0.2, 1.3),
    ("sad", -0.5, 1.0, 1.0),
    ("stupid", -0.8, 1.0, 1.0),
    ("terrible", -1.0, 1.0, 1.0),
    ("trash", -0.6, 0.7, 1.0),
    ("useful", 0.3, 0.0, 1.0),
    ("useless", -0.5, 0.2, 1.0),
    ("very", 0.2, 0.3, 1.3),
    ("wonderful", 1.0, 1.0, 1.0),
    ("worst", -1.0, 1.0, 1.0),
    ("worthless", -0.8, 0.9, 1.0),
    ("wrong", -0.5, 0.9, 1.0),
]

# Default negations: they flip the word after them (one intensifier may stand between).
NEGATIONS = [
    "can't", "cannot", "doesn't", "don't", "isn't", "never", "no", "not", "nothing", "wasn't",
    "without", "won't",
]

# Default prompt wordings. Each takes the context and the question (or the two sites).
CHAT_PROMPT = (
    "You help people understand a web page. Build on the page context below and add well-known "
    "background where it helps.\n\nContext:\n%s\n\nQuestion: %s\n\nAnswer:"
)
FACT_CHECK_PROMPT = (
    "You check facts. Test the claims in the page context below against what you know, and name "
    "errors, missing nuance and bias.\n\nContext:\n%s\n\nQuestion: %s\n\nAnswer:"
)
COMPARE_PROMPT = (
    "Compare how two web pages treat their subject: tone, focus, bias and what each leaves out.\n\n"
    "Page 1 (%s):\n%s\n\nPage 2 (%s):\n%s\n\nSummary:"
)
