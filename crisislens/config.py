"""Fixed values the engine must share with the reference behaviour.

Everything in this module is data, not logic: candidate header names, the
narrative lexicon, sentiment labels and the thresholds of the rule
classifiers.  Operators read them; callers may pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES — logical column -> candidate physical header names, in the
# order they are tried (first exact match after name normalisation wins).
# ---------------------------------------------------------------------------
COLUMN_CANDIDATES: dict[str, list[str]] = {
    "date": ["Date", "datetime", "created_at", "post date", "postDate", "date_publication"],
    "url": ["Url", "URL", "link", "lien"],
    "sentiment": ["Sentiment", "sentiment_label", "tonalite"],
    "language": ["Language", "langue", "lang"],
    "country": ["Country", "pays"],
    "author": ["Author", "auteur", "username", "screen_name", "user", "compte"],
    "likes": ["Likes", "like_count", "likes_count", "nombre_likes"],
    "comments": ["Comments", "Replies", "reply_count", "comments_count", "reponses"],
    "shares": ["Shares", "Retweets", "retweet_count", "reposts", "partages"],
    "text": ["Full Text", "Text", "Tweet", "message", "content", "contenu", "texte"],
    "text_norm": ["message_normalizer", "message normalizer", "normalized_text", "texte_normalise", "text_norm"],
    "impressions": ["Impressions", "views", "vues"],
    "mentions": ["Mentioned Authors", "mentions", "mentioned_authors"],
    "followers": ["X Followers", "followers", "abonnes", "followers_count"],
    "following": ["X Following", "following", "abonnements"],
    "reply_to": ["X Reply to", "reply_to", "in_reply_to"],
    "repost_of": ["X Repost of", "repost_of", "retweeted_status", "retweeted_author"],
    "x_posts": ["X Posts", "statuses_count", "posts_count"],
    "verified": ["X Verified", "verified", "certified"],
    "reach": ["Reach", "audience", "portee"],
    "engagement_type": ["Engagement Type", "type", "interaction_type", "type_engagement"],
    "hashtags": ["Hashtags", "hashtags", "tags"],
    "post_id": ["postID", "post_id", "id", "tweet_id"],
    "post_date": ["postDate", "post_date"],
}

REQUIRED_COLUMNS: tuple[str, ...] = ("date", "author", "text")

# Numeric metrics carried by every enriched post (absent source -> 0).
METRIC_COLUMNS: tuple[str, ...] = (
    "likes", "comments", "shares", "impressions", "reach", "followers", "following", "x_posts",
)


@dataclass(frozen=True)
class Narrative:
    label: str
    patterns: tuple[str, ...]
    sensitive: bool


# ---------------------------------------------------------------------------
# FIXED VALUES — default narrative lexicon, in priority order.  Patterns are
# regular expressions searched (unanchored, case-insensitive) in the
# accent-folded lower-case text.  `sensitive` narratives raise the risk level.
# ---------------------------------------------------------------------------
DEFAULT_LEXICON: tuple[Narrative, ...] = (
    Narrative("Argent public / subventions", (
        r"argent public", r"subvention", r"subventionne", r"subventionnee", r"subventions",
        r"impot", r"impots", r"taxe", r"taxes", r"racket fiscal", r"vache a lait",
        r"fonds", r"finance", r"financer", r"financement", r"3 m", r"3m", r"millions",
    ), True),
    Narrative("Copinage / favoritisme", (
        r"copinage", r"favoritisme", r"favoriser", r"favorisera", r"potes", r"amis", r"proches",
        r"commission", r"corruption", r"clientelisme", r"entre soi", r"detournement",
    ), True),
    Narrative("Critique institutionnelle CNC", (
        r"\bcnc\b", r"centre national", r"institution", r"commission d aide", r"ministere", r"culture",
    ), False),
    Narrative("Ultia / Twitch", (
        r"ultia", r"twitch", r"streameuse", r"stream", r"live", r"youtube", r"tiktok",
    ), False),
    Narrative("Censure / idéologie", (
        r"censure", r"extreme droite", r"extreme-droite", r"ideologie", r"politique", r"gauche", r"droite",
        r"discrimination", r"ecarter", r"ecartera",
    ), True),
    Narrative("Suspension du fonds", (
        r"suspend", r"suspension", r"supprime", r"suppression", r"arrete le fonds", r"met fin", r"fonds d aide",
    ), True),
    Narrative("Harcèlement / menaces", (
        r"harcelement", r"cyberharcelement", r"menace", r"menaces", r"insulte", r"haine", r"violence",
    ), True),
    Narrative("Relais média / actualité", (
        r"flash", r"alerte", r"info", r"journal", r"media", r"article", r"communique", r"breaking",
    ), False),
)

# FIXED VALUES — label given to a post that matches no narrative.
DEFAULT_NARRATIVE = "Autre / non classé"

# FIXED VALUES — sentiment labels counted as negative.
NEGATIVE_SENTIMENTS: tuple[str, ...] = ("negative", "negatif", "négatif", "neg")

# FIXED VALUES — engagement-type patterns (searched anywhere in the upper-cased type).
RETWEET_TYPE_PATTERN = "RETWEET|REPOST|RT"
REPLY_TYPE_PATTERN = "REPLY|REPONSE|RÉPONSE"
QUOTE_TYPE_PATTERN = "QUOTE|CITATION"
RETWEET_TEXT_PREFIX = "RT "

# FIXED VALUES — defaults of the table operators.
DEFAULT_SENTIMENT = "unknown"
DEFAULT_ENGAGEMENT_TYPE = "ORIGINAL"
DEFAULT_AUTHOR = "unknown"
REACH_QUANTILE = 0.95
COPY_FINGERPRINT_CHARS = 220
COPY_MIN_FINGERPRINT_LEN = 40   # fingerprints must be strictly longer
COPY_EXAMPLE_CHARS = 260
COPY_MIN_COUNT = 3
COPY_TOP = 15
BURST_TOP = 12
ZSCORE_EPS = 1e-9
