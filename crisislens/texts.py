"""FIXED VALUES — message templates of the drafting step, one per channel, in
the order messages are produced.  Placeholders: {spokesperson}, {niveau},
{score}, {dominant}.  Only these are substituted; the rest is verbatim."""

from __future__ import annotations

DEFAULT_CHANNELS = ("Post X court", "Communiqué", "FAQ", "Réponse journaliste", "Message interne")
DEFAULT_SPOKESPERSON = "Le CNC"
DEFAULT_TONE = "Institutionnel, clair et apaisant"

CHANNEL_TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Post X court",
     "{spokesperson} prend acte des interrogations suscitées par cette situation. "
     "Notre priorité est de rappeler les faits, les règles applicables et les garanties d'impartialité. "
     "Des éléments de clarification seront partagés de manière transparente, dans un cadre factuel et apaisé."),
    ("Thread X",
     "1/ Plusieurs questions circulent au sujet du dispositif d'aide concerné. Nous souhaitons clarifier les faits "
     "sans alimenter la polémique.\n\n"
     "2/ Les décisions d'attribution reposent sur des critères et procédures encadrés. Les règles de sélection et les "
     "garanties d'impartialité doivent rester le point central du débat.\n\n"
     "3/ Nous condamnons toute menace ou attaque personnelle. Les critiques peuvent être entendues, mais elles doivent "
     "rester dans un cadre respectueux.\n\n"
     "4/ Une synthèse factuelle sera mise à disposition afin de répondre aux principales interrogations."),
    ("Communiqué",
     "**Communiqué — {spokesperson}**\n\n"
     "Depuis plusieurs heures, de nombreuses réactions circulent sur les réseaux sociaux au sujet d'un dispositif "
     "d'aide. Nous comprenons que cette situation suscite des interrogations, notamment sur les règles d'attribution, "
     "l'impartialité des commissions et l'usage des fonds publics.\n\n"
     "Notre réponse se veut factuelle : les procédures doivent être lisibles, vérifiables et compréhensibles par le "
     "public. Les éléments nécessaires seront rappelés de manière transparente, sans personnalisation du débat et "
     "sans prise de position partisane.\n\n"
     "Nous condamnons par ailleurs toute menace, attaque personnelle ou forme de harcèlement. La discussion publique "
     "doit pouvoir se tenir dans un cadre respectueux.\n\n"
     "Notre priorité est de préserver la confiance, de clarifier les règles et de permettre une compréhension "
     "précise du fonctionnement du dispositif."),
    ("FAQ",
     "**FAQ — éléments de réponse**\n\n"
     "**1. Pourquoi communiquer maintenant ?**\n"
     "Parce que le volume de réactions et la vitesse de propagation justifient une clarification factuelle.\n\n"
     "**2. Quel est le point central ?**\n"
     "Le point central est la compréhension des règles, des critères d'attribution et des garanties d'impartialité."
     "\n\n"
     "**3. Est-ce une fake news ?**\n"
     "Le sujet ne doit pas être réduit à une fake news. Il s'agit d'une dynamique virale autour de faits, "
     "d'interprétations et de narratifs concurrents.\n\n"
     "**4. Que faut-il éviter ?**\n"
     "Éviter les attaques personnelles, les formulations politiques et toute accusation non vérifiée.\n\n"
     "**5. Qui valide la réponse ?**\n"
     "Les messages proposés par l'IA doivent être relus et validés par une cellule humaine avant toute publication."),
    ("Réponse journaliste",
     "Bonjour,\n\n"
     "Nous confirmons suivre attentivement les réactions en cours. Notre position est de traiter ce sujet de manière "
     "factuelle, en rappelant les règles applicables, les critères de sélection et les garanties d'impartialité. "
     "Nous ne souhaitons pas personnaliser le débat ni l'inscrire dans un affrontement politique.\n\n"
     "Des éléments de clarification pourront être transmis dès validation par la cellule communication.\n\n"
     "Bien cordialement,"),
    ("Message interne",
     "**Message interne — cellule de crise**\n\n"
     "Niveau détecté : {niveau} — score {score}/100.\n"
     "Narratif dominant : {dominant}.\n\n"
     "Priorité : stabiliser les faits, éviter les réactions individuelles et centraliser la validation des messages. "
     "Ne pas répondre directement aux interpellations sans validation. Surveiller les reprises médias, les menaces et "
     "les mutations de narratif."),
    ("Message d'attente",
     "Nous avons pris connaissance des nombreuses réactions en cours. "
     "Une clarification factuelle est en préparation afin de répondre aux principales interrogations. "
     "Notre priorité est de fournir des informations précises, vérifiables et respectueuses du débat public."),
)

# FIXED VALUES — crisis brief (period diagnosis) lines, in order.
BRIEF_TITLE = "## Brief Agent 1 — Analyste de crise"
BRIEF_STRATEGY = (
    "- Le sujet doit être traité comme une **dynamique virale**, pas comme une simple vérification de fake news.",
    "- Le point à surveiller est la mutation du débat : personne impliquée → institution → argent public / "
    "légitimité du fonds.",
    "- La cellule de crise doit répondre sur les règles, la transparence et les faits, sans entrer dans un "
    "affrontement politique.",
)
BRIEF_NEGATIVE = ("- Le climat dominant étant négatif, la réponse doit éviter toute formulation défensive ou "
                  "agressive.")
NOT_AVAILABLE = "n/a"
NOT_IDENTIFIED = "non identifié"

# FIXED VALUES — strategy constants (objective, targets, axes, plan, avoid,
# risks, escalation triggers), in order.
DEFAULT_OBJECTIVE = "Rétablir la confiance et clarifier les faits"
DEFAULT_TARGETS = ("Grand public", "Médias", "Créateurs concernés")
DEFAULT_RISK_TOLERANCE = "Prudente"
DEFAULT_RESPONSE_WINDOW = "Prochaines 24 heures"
MESSAGE_AXES = (
    ("Clarification factuelle",
     "Recentrer la discussion sur les faits vérifiables et le périmètre exact de la décision.",
     "Rappeler le calendrier, la décision prise et les règles applicables sans commenter les personnes."),
    ("Transparence des règles",
     "Répondre au narratif argent public/copinerie sans agressivité.",
     "Expliquer les critères d'attribution, les procédures de sélection et les garde-fous existants."),
    ("Apaisement",
     "Réduire la polarisation et éviter de nourrir la polémique.",
     "Reconnaître les interrogations du public et s'engager à fournir des informations claires."),
    ("Human-in-the-loop",
     "Montrer que l'IA assiste mais ne décide pas.",
     "Tout message proposé doit être validé par la cellule communication avant publication."),
)
ACTION_PLAN = (
    ("0–1 h", "Stabiliser le diagnostic",
     "Valider le pic, les narratifs dominants, les comptes moteurs et les publications les plus engageantes."),
    ("1–3 h", "Préparer les éléments de langage",
     "Rédiger une clarification courte + une FAQ interne sur critères, gouvernance et calendrier."),
    ("3–6 h", "Choisir le canal de réponse",
     "Publier seulement si le narratif continue de monter ou si des médias/influenceurs structurants relaient."),
    ("6–24 h", "Suivre la mutation narrative",
     "Surveiller si la crise passe d'Ultia vers argent public, censure, sécurité ou défiance institutionnelle."),
)
AVOID = (
    "Ne pas attaquer les internautes, journalistes, créateurs ou camps politiques.",
    "Ne pas minimiser la colère : préférer reconnaître les interrogations.",
    "Ne pas employer de termes accusatoires non prouvés comme 'bots' ou 'manipulation organisée'.",
    "Ne pas publier un message long et défensif sur X en premier réflexe.",
    "Ne pas promettre une enquête, une sanction ou une réforme si ce n'est pas validé en interne.",
)
RISKS_IF_SILENT = (
    "Le vide de communication peut laisser le narratif dominant s'installer.",
    "Les comptes moteurs peuvent imposer leur cadrage sans contradiction factuelle.",
    "Le débat peut muter vers une critique plus large de l'institution et des aides publiques.",
)
RISKS_IF_OVERREACTING = (
    "Une réponse trop défensive peut relancer le pic et générer de nouveaux quote tweets.",
    "Une réponse politique peut confirmer le narratif de partialité/censure.",
    "Une réponse trop juridique peut paraître froide ou opaque.",
)
ESCALATION_TRIGGERS = (
    "Nouveau pic horaire supérieur au pic précédent ou reprise par un média national.",
    "Hausse du narratif 'argent public/copinerie' sur plusieurs heures.",
    "Apparition de menaces, doxxing, appels ciblés ou risque de sécurité.",
    "Interpellation directe d'un décideur, ministère, partenaire ou média majeur.",
)
PACK_FINAL_RULE = ("**Règle finale :** aucun message n'est publié automatiquement. La cellule communication garde la "
                   "décision finale.")

# FIXED VALUES — answer sections of the question router.
ANSWER_EMPTY = "Pose une question sur le diagnostic, les narratifs, la propagation, la stratégie ou les messages."
ANSWER_SOURCES_PREFIX = "\n\n---\n**Sources utilisées en priorité :** "
# Answer sections by source, then the synthesis; {names} are filled in.
ANSWER_SECTIONS = (
    "### Réponse basée sur l'Agent 1 — Diagnostic\n- Période analysée : **{debut} → {fin}**.\n- Niveau : **{niveau}** ; "
    "Crisis Velocity Score : **{score}/100**.\n- Messages : **{messages}** ; auteurs uniques : **{auteurs}**.\n"
    "- Retweets/reposts : **{retweets}%** ; sentiment négatif : **{negatif}%**.\n- Narratif dominant détecté : **{dominant}**.\n",
    "### Réponse basée sur l'Agent 2 — Narratifs\nNarratifs prioritaires détectés :{narratifs}",
    "### Réponse basée sur l'Agent 3 — Propagation\n- Score de coordination prudente : **{coordination}/100** ({label}).\n"
    "- Lecture : il s'agit de **signaux de propagation**, pas d'une preuve de bots ou de manipulation.\n"
    "- Métriques disponibles : {metriques}.\n\n{rapport3}",
    "### Réponse basée sur l'Agent 4 — Stratégie de riposte\n- Priorité : **{priorite}**.\n- Posture recommandée : **{posture}**.\n\n{rapport4}",
    "### Réponse basée sur l'Agent 5 — Messages et garde-fous\n{rapport5}",
    "### Synthèse basée sur les Agents 1 à 5\nLe diagnostic Agent 1 indique un niveau **{niveau}** avec un score de **{score}/100**. "
    "Le narratif dominant est **{dominant}**. Pour une question précise, demande par exemple : `Pourquoi le pic est important ?`, "
    "`Quels narratifs dominent ?`, `Y a-t-il des signaux de coordination ?`, `Quelle stratégie recommandes-tu ?` ou `Rédige un post X`.",
)
ANSWER_NARRATIVE_LINE = "\n- **{narratif}** : {messages} messages, score stratégique {score}/100, angle : {angle}"
SOURCE_PRIORITY = (
    "Agent 1 — diagnostic chiffré",
    "Agent 2 — narratifs / acteurs",
    "Agent 3 — propagation / coordination prudente",
    "Agent 4 — stratégie de riposte",
    "Agent 5 — messages / garde-fou",
)
