from pyspark.sql import functions as F

from crisislens.functions import rules as RU

QUICK = [
    "Pourquoi le pic principal est-il important ?",
    "Quels narratifs dominent et lesquels sont les plus risqués ?",
    "Y a-t-il des signaux de coordination ou de copier-coller ?",
    "Quelle stratégie de réponse recommandes-tu ?",
    "Rédige un post X prudent pour le CNC.",
    "Quelles sont les limites de notre analyse ?",
]


def test_guardrail_statuses(spark):
    msgs = [
        ("bad", "Ces bots sont des menteurs, nous garantissons une sanction immédiate."),
        ("clean", "Nous rappelons les faits et la procédure ; la cellule communication valide avec respect."),
        ("stems", "Une approche transparente et apaisée, avec validation des règles."),
        ("empty", ""),
    ]
    df = spark.createDataFrame(msgs, "canal string, text string")
    g = RU.guardrail(F.col("text"))
    rows = {r.canal: r for r in df.select("canal", *[c.alias(k) for k, c in g.items()]).collect()}
    assert rows["bad"].statut == RU.STATUS_FIX and "accusation non prouvée" in rows["bad"]["risques_detectés"]
    assert "promesse non validée" in rows["bad"]["risques_detectés"]
    assert rows["clean"].statut == RU.STATUS_CLEAN and rows["clean"]["points_à_renforcer"] == "RAS"
    # stems with a closing word boundary miss derived words (reference behaviour)
    assert rows["stems"].statut == RU.STATUS_REVIEW
    assert rows["empty"]["longueur_caractères"] == 0 and rows["empty"].statut == RU.STATUS_REVIEW


def test_routing(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUICK + ["   ", "Merci beaucoup", "Bonjour"])], "i int, q string")
    got = [r.s for r in df.select("i", RU.route_question(F.col("q")).alias("s")).orderBy("i").collect()]
    assert got[0][0] == "Agent 1 — Diagnostic"
    assert "Agent 2 — Narratifs / acteurs" in got[1]
    assert "Agent 3 — Propagation / coordination prudente" in got[2]
    assert "Agent 4 — Stratégie" in got[3]
    assert "Agent 5 — Rédaction / garde-fou" in got[4]
    assert got[6] == [] and got[7] == [RU.ROUTE_FALLBACK]
    assert got[8] == ["Agent 1 — Diagnostic"]       # greedy substring: 'bonjour' contains 'jour'



def test_priority_posture_points(spark):
    df = spark.createDataFrame([("Harcèlement / menaces", 10.0), ("Ultia / Twitch", 65.0),
                                ("Argent public / subventions", 85.0)], "d string, s double")
    rows = df.select(RU.priority_from_score(F.col("s")).alias("p"), RU.response_posture(F.col("d"), F.col("s")).alias("o"),
                     RU.sensitive_points(F.col("d")).alias("pts")).collect()
    assert rows[0].p.startswith("P4") and rows[0].o.startswith("Empathique")
    assert rows[1].p.startswith("P2") and rows[1].o.startswith("Factuel")
    assert rows[2].p.startswith("P1") and rows[2].o.startswith("Transparence") and len(rows[2].pts) == 3
