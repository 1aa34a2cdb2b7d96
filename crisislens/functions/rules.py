"""Rule classifiers as Column expressions: priority, posture, sensitive
points, message guardrail and question routing.  All run JVM-side on any
table of rows (periods, messages, conversation turns, questions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, contains_any, portable_regex, trim_ws

# FIXED VALUES — priority by crisis score (first threshold reached wins).
PRIORITIES = (
    (80, "P1 — Crise forte : cellule de crise active, validation direction, suivi horaire"),
    (60, "P2 — Crise élevée : réponse préparée, monitoring renforcé, validation communication"),
    (40, "P3 — Crise modérée : clarification possible, surveillance des relais"),
)
PRIORITY_DEFAULT = "P4 — Signal faible : monitoring, pas de réponse publique immédiate sauf sollicitation"

# FIXED VALUES — response posture: rules on the dominant narrative, then score.
POSTURE_RULES = (
    (("harc", "menace"),
     "Empathique + sécurité : condamner les menaces, rappeler les faits, protéger les personnes"),
    (("argent", "subvention", "copinage"),
     "Transparence + pédagogie : expliquer les règles, critères, garde-fous et gouvernance"),
    (("censure", "idéologie", "ideologie"),
     "Neutralité institutionnelle : rappeler les principes sans entrer dans l'affrontement politique"),
)
POSTURE_HIGH = "Factuel + apaisement : reconnaître l'inquiétude, clarifier, éviter de sur-réagir"
POSTURE_DEFAULT = "Monitoring + réponse réactive : répondre seulement aux sollicitations qualifiées"

# FIXED VALUES — sensitive points (two always, then one per matching theme).
SENSITIVE_ALWAYS = (
    "Ne pas traiter le dossier comme une simple fake news : les faits de départ sont datés et vérifiables.",
    "Le cœur du risque est la dynamique virale et la perte de confiance institutionnelle.",
)
SENSITIVE_RULES = (
    (("argent", "subvention", "copinage", "favoritisme"),
     "Le narratif attaque la légitimité des aides publiques : réponse nécessaire sur transparence, critères et "
     "gouvernance."),
    (("censure", "idéologie", "ideologie"),
     "Le sujet peut être recadré politiquement : éviter tout vocabulaire partisan."),
    (("harc", "menace"),
     "Risque de sécurité/réputation : condamner les menaces sans nier les critiques légitimes."),
)

# FIXED VALUES — guardrail patterns (searched case-insensitively in the
# lower-cased message), labels and statuses.
FORBIDDEN_PATTERNS = (
    ("attaque personnelle", r"\b(idiot|imbecile|menteur|mensonge|honte a vous|facho|gauchiste)\b"),
    ("accusation non prouvée", r"\b(bot|bots|manipulation organisée|complot|corruption prouvée|détournement prouvé)\b"),
    ("promesse non validée", r"\b(nous garantissons|nous promettons|enquête officielle immédiate|sanction immédiate)\b"),
)
EXPECTED_PATTERNS = (
    ("factuel/transparence", r"\b(fait|factuel|transparen|règle|regle|critère|critere|procédure|procedure)\b"),
    ("apaisement", r"\b(apais|interrogation|respect|clarification|comprend|écoute|ecoute)\b"),
    ("validation humaine", r"\b(valid|cellule|communication|humain|relecture)\b"),
)
STATUS_FIX = "À corriger avant validation"
STATUS_CLEAN = "Propre, mais validation humaine requise"
STATUS_REVIEW = "À valider humainement"
NO_RISK = "Aucun risque majeur détecté"
NOTHING_MISSING = "RAS"
RISK_PREFIX = "risque : "

# FIXED VALUES — question routing: keyword sets in source order, fallback.
ROUTES = (
    ("Agent 1 — Diagnostic",
     ("diagnostic", "score", "kpi", "chiffre", "pic", "volume", "jour", "période", "periode", "retweet", "rt",
      "reach", "sentiment")),
    ("Agent 2 — Narratifs / acteurs",
     ("narratif", "narratifs", "thème", "theme", "mutation", "acteur", "acteurs", "risque narratif", "angle")),
    ("Agent 3 — Propagation / coordination prudente",
     ("propagation", "coordination", "bot", "bots", "copier", "copie", "gabarit", "vitesse", "cascade",
      "concentration", "amplification")),
    ("Agent 4 — Stratégie",
     ("stratégie", "strategie", "réponse", "reponse", "riposte", "quoi faire", "priorité", "priorite", "plan",
      "silence", "sur-réaction", "surreaction")),
    ("Agent 5 — Rédaction / garde-fou",
     ("message", "tweet", "post", "communiqué", "communique", "faq", "journaliste", "interne", "rédige", "redige",
      "formulation", "publier")),
)
ROUTE_FALLBACK = "Agents 1 à 5 — synthèse"


def threshold_label(score: Column, table, default: str) -> Column:
    out = None
    for threshold, label in table:
        out = F.when(score >= threshold, label) if out is None else out.when(score >= threshold, label)
    return out.otherwise(default)


def priority_from_score(score: Column) -> Column:
    return threshold_label(score, PRIORITIES, PRIORITY_DEFAULT)


def response_posture(dominant: Column, score: Column) -> Column:
    low = F.lower(F.coalesce(dominant, F.lit("")))
    out = None
    for words, answer in POSTURE_RULES:
        hit = contains_any(low, words)
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return out.when(F.coalesce(score, F.lit(0)) >= 60, POSTURE_HIGH).otherwise(POSTURE_DEFAULT)


def sensitive_points(dominant: Column) -> Column:
    low = F.lower(F.coalesce(dominant, F.lit("")))
    extra = [F.when(contains_any(low, words), F.lit(text)) for words, text in SENSITIVE_RULES]
    return F.concat(F.array(*[F.lit(t) for t in SENSITIVE_ALWAYS]), F.array_compact(F.array(*extra)))


def _search(text_lower: Column, pattern: str) -> Column:
    return text_lower.rlike("(?i)" + portable_regex(pattern))


def guardrail(text: Column) -> dict[str, Column]:
    """Guardrail columns for one message text (any text table)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    flags = F.array_compact(F.array(*[F.when(_search(low, p), F.lit(RISK_PREFIX + label))
                                      for label, p in FORBIDDEN_PATTERNS]))
    missing = F.array_compact(F.array(*[F.when(~_search(low, p), F.lit(label)) for label, p in EXPECTED_PATTERNS]))
    status = (F.when(F.size(flags) > 0, STATUS_FIX).when(F.size(missing) <= 1, STATUS_CLEAN)
              .otherwise(STATUS_REVIEW))
    return {
        "statut": status,
        "risques_detectés": F.when(F.size(flags) > 0, F.array_join(flags, "; ")).otherwise(NO_RISK),
        "points_à_renforcer": F.when(F.size(missing) > 0, F.array_join(missing, "; ")).otherwise(NOTHING_MISSING),
        "longueur_caractères": F.length(F.coalesce(text, F.lit(""))).cast("bigint"),
    }


def normalize_question(question: Column) -> Column:
    """lower, trim, whitespace runs -> one space."""
    return F.regexp_replace(trim_ws(F.lower(F.coalesce(question, F.lit("")))), f"{SPACE}+", " ")


def route_question(question: Column) -> Column:
    """Ordered list of sources a question is routed to ([] for blank)."""
    qn = normalize_question(question)
    hits = F.array_compact(F.array(*[F.when(contains_any(qn, words), F.lit(src)) for src, words in ROUTES]))
    return (F.when(qn == "", F.array().cast("array<string>"))
            .when(F.size(hits) == 0, F.array(F.lit(ROUTE_FALLBACK))).otherwise(hits))
