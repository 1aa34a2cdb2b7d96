import os

from crisislens.operators.enrich import enrich
from crisislens.sources.readers import read_data_directory, read_dataset


def _write(path, text, encoding):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_utf8_comma_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "posts.csv")
    _write(p, 'Date,Author,Full Text,Likes\n2024-03-26 10:00:00,@x,"Réponse, avec virgule",3\n', "utf-8")
    df = read_dataset(spark, p)
    r = df.first()
    assert df.columns == ["Date", "Author", "Full Text", "Likes"] and r["Full Text"] == "Réponse, avec virgule"
    assert enrich(df).first().likes == 3.0


def test_latin1_semicolon_fallback(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "posts_latin1.csv")
    _write(p, "Date;Auteur;Texte\n2024-03-26 10:00:00;élodie;Ministère de la Culture\n", "latin-1")
    df = read_dataset(spark, p)
    r = df.first()
    assert df.columns == ["Date", "Auteur", "Texte"] and r["Auteur"] == "élodie"
    assert r["Texte"] == "Ministère de la Culture"


def test_directory_reads_all_data_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "dir", "sub")
    os.makedirs(d)
    for name in ("a.csv", "b.csv", "dictionnaire.csv"):
        _write(os.path.join(d, name), "Date,Author,Text\n2024-01-01 00:00:00,u,t\n", "utf-8")
    assert read_data_directory(spark, os.path.join(tmpdir_path, "dir")).count() == 2


def test_mixed_files_are_united_by_name(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "mixed", "sub")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "Date,Author,Text\n2024-01-01 00:00:00,élan,caf\ufffdé\n", "utf-8")
    _write(os.path.join(d, "b.csv"), "Author,Date,Text\nbob,2024-01-02 00:00:00,\"two\nlines\"\n", "utf-8")
    _write(os.path.join(d, "c.csv"), "Date;Text;Author\n2024-01-03 00:00:00;été;zoé\n", "latin-1")
    _write(os.path.join(d, "d.txt"), "no,csv\n1,2\n", "utf-8")
    got = {r.Date: (r.Author, r.Text) for r in read_dataset(spark, os.path.join(tmpdir_path, "mixed"), "csv", recursive=True, glob="*.csv").collect()}
    assert got == {"2024-01-01 00:00:00": ("élan", "caf\ufffdé"), "2024-01-02 00:00:00": ("bob", "two\nlines"), "2024-01-03 00:00:00": ("zoé", "été")}
