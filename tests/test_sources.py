import json

from pyspark.sql import functions as F

from pairlog.operators.reshape import curves_long, hashtags_long, prepost_long
from pairlog.sources import files


def test_interactions(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "Identifier,id,random ID,TrialNumber,Response,Group,Points\nf20h1,1,r1,1,emily,0,1\nf20h1,2,r2,1,NA,0,0\n")
    d = files.read_interactions(spark, str(tmp_path / "log.csv"))
    r = d.orderBy("id").first()
    assert (r.random_id, r.TrialNumber, r.Response, r.partner_id) == ("r1", 1, "emily", None)
    assert d.schema["Group"].dataType.simpleString() == "int"


def test_run_files(spark, tmp_path):
    head = "id,ResponseType,TrialNumber,Response,Group,Points,DecisionType\n"
    (tmp_path / "f20h1.csv").write_text(head + "1,name,1,emily,0,1,BN\n")
    (tmp_path / "h50s2.csv").write_text(head + "1,hashtag,1,tsunami,0,0,BN\n2,hashtag,1,waves,0,0,BN\n")
    d = files.read_run_files(spark, str(tmp_path / "*.csv"))
    got = {(r.Identifier, r.Content, r.Size, r.Structure, r.Run, r.n) for r in d.groupBy(
        "Identifier", "Content", "Size", "Structure", "Run").agg(F.count("*").alias("n")).collect()}
    assert got == {("f20h1", "Face", 20, "Homogeneous", 1, 1), ("h50s2", "Hashtag", 50, "Spatial", 2, 2)}


def prepost_file(tmp_path):
    names = (["RecordedDate", "tweet1"] + [f"hashtag1_{i}" for i in range(1, 11)]
             + ["tweet2"] + [f"hashtag2_{i}" for i in range(1, 11)] + ["random ID"])
    row = lambda t1, t2, tags, rid: ",".join(["5/22/2024 12:30", t1, *tags, t2, *tags, rid])
    tags = [f"#t{i}" for i in range(9)] + [""]
    (tmp_path / "h20s2pp.csv").write_text("\n".join([
        ",".join(names), row('"Waves, then\nenergy ""loss"""', '"Tōhoku "', tags, "11"), row('"plain"', "", tags, "12")]) + "\n")
    return str(tmp_path / "h20s2pp.csv")


def test_prepost(spark, tmp_path):
    d = files.read_prepost(spark, prepost_file(tmp_path))
    rows = d.orderBy("random_id").collect()
    assert [r.random_id for r in rows] == ["11", "12"]
    assert rows[0].tweet1 == 'Waves, then\nenergy "loss"' and rows[0].tweet2.strip() == "Tōhoku"
    assert (rows[0].Content, rows[0].Size, rows[0].Structure, rows[0].Run) == ("Hashtag", 20, "Spatial", 2)
    assert str(rows[0].recorded_at) == "2024-05-22 12:30:00"
    assert prepost_long(d).count() == 3
    tags = hashtags_long(d).orderBy("random_id", "Phase", "position").collect()
    assert len(tags) == 2 * 2 * 9 and tags[0].Phase == "post" and tags[0].position == 1 and tags[0].hashtag == "#t0"


def test_pairs_with_and_without_header(spark, tmp_path):
    (tmp_path / "connection_4.2.2_1.csv").write_bytes(b"1,2,1\r\n3,4,1\r\n1,4,2\r\n2,3,2\r\n")
    (tmp_path / "connection_4.1.2_12.csv").write_text("Node1,Node2,Trial\n1,3,1\n2,4,1\n")
    d = files.read_pairs(spark, str(tmp_path / "connection_*.csv"))
    assert d.count() == 6
    r = d.where("seed = 12").first()
    assert (r.n, r.trials, r.neighbourhood, r.Node2) == (4, 1, 2, 3)
    assert {x.Trial for x in d.where("seed = 1").collect()} == {1, 2}


def test_survey(spark, tmp_path):
    question = {"QuestionText": "Write", "DataExportTag": "Q1", "QuestionType": "TE", "Selector": "ESTB",
                "Validation": {"Settings": {"Type": "TotalChar", "MinChars": "50", "TotalChars": "280"}}}
    survey = {"SurveyEntry": {"SurveyID": "S", "SurveyName": "demo"}, "SurveyElements": [
        {"Element": "BL", "PrimaryAttribute": "B", "Payload": [{"x": 1}]},
        {"Element": "SQ", "PrimaryAttribute": "QID1", "Payload": question}]}
    (tmp_path / "s.qsf").write_text(json.dumps(survey, indent=1))
    rows = files.read_survey(spark, str(tmp_path / "s.qsf")).collect()
    assert [(r.survey, r.question_id, r.tag, r.min_chars, r.max_chars) for r in rows] == [("demo", "QID1", "Q1", 50, 280)]


def test_tables_by_header(spark, tmp_path):
    (tmp_path / "claims.csv").write_text(',text,cause,effect,cause_cluster,effect_cluster\n0,"a\nb",x,y,-1,19\n')
    (tmp_path / "tweets.csv").write_text("random.ID,Phase,Structure,Content,Size,Response\n7,pre,Spatial,Face,20,hello\n")
    (tmp_path / "sweep.csv").write_text(",alpha,entropy_dist,bn_dist,ec_dist,rs_dist,rp_dist\n0,0.1,1,2,3,4,5\n")
    (tmp_path / "curves.csv").write_text(",Trial,Human Spatial Face,Model Spatial Face\n1,1,0.5,0.25\n")
    c = files.read_claims(spark, str(tmp_path / "claims.csv")).first()
    assert (c.text, c.cause_cluster, c.effect_cluster) == ("a\nb", -1, 19)
    t = files.read_tweets(spark, str(tmp_path / "tweets.csv")).first()
    assert (t.random_id, t.Phase, t.Size) == ("7", "pre", 20)
    assert tuple(files.read_sweep(spark, str(tmp_path / "sweep.csv")).first())[:2] == (0.1, 1.0)
    long = {tuple(r) for r in curves_long(files.read_curves(spark, str(tmp_path / "curves.csv"))).collect()}
    assert long == {(1, "Human", "Spatial", "Face", 0.5), (1, "Model", "Spatial", "Face", 0.25)}


def test_write_table(spark, log, tmp_path):
    path = str(tmp_path / "out")
    files.write_table(log, path, ["Content"])
    back = spark.read.parquet(path)
    assert back.count() == log.count() and (tmp_path / "out" / "Content=Face").exists()
    files.write_table(log.select("Identifier", "id"), str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == log.count()


def test_sample_schedule(spark):
    runs = spark.createDataFrame([(f"r{i}", 4) for i in range(50)], "Identifier string, Size int")
    schedules = spark.createDataFrame([(4, s, 1, 2, 1) for s in range(1, 11)], "n int, seed int, Node1 int, Node2 int, Trial int")
    got = files.sample_schedule(runs, schedules, seed=3).collect()
    assert len(got) == 50 and len({r.seed for r in got}) > 5
    assert {(r.Identifier, r.seed) for r in got} == {(r.Identifier, r.seed) for r in files.sample_schedule(runs, schedules, seed=3).collect()}


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Identifier,id,TrialNumber,Response\nf20h1,1,7,emily\n")
    (tmp_path / "b.csv").write_text("Response,extra,TrialNumber,random ID,id,Identifier\nanna,zz,3,r9,2,f20h1\n")
    got = {(r.id, r.TrialNumber, r.Response, r.random_id) for r in files.read_interactions(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {(1, 7, "emily", None), (2, 3, "anna", "r9")}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "f20h1.csv").write_text("id,TrialNumber,ResponseType,Response\n1,4,name,emily\n")
    (tmp_path / "runs" / "h50s2.csv").write_text("Response,id,ResponseType,TrialNumber\nwaves,2,hashtag,5\n")
    got = {(r.Identifier, r.id, r.TrialNumber, r.ResponseType, r.Response, r.Size) for r in files.read_run_files(spark, str(tmp_path / "runs")).collect()}
    assert got == {("f20h1", 1, 4, "name", "emily", 20), ("h50s2", 2, 5, "hashtag", "waves", 50)}


def test_tables_whose_files_differ(spark, tmp_path):
    (tmp_path / "claims").mkdir()
    (tmp_path / "claims" / "a.csv").write_text(",text,cause,effect,cause_cluster,effect_cluster\n0,c1,x1,y1,1,2\n")
    (tmp_path / "claims" / "b.csv").write_text("effect_cluster,cause,text,effect,cause_cluster,more\n4,x2,c2,y2,3,z\n")
    got = {(c.text, c.cause, c.effect, c.cause_cluster, c.effect_cluster) for c in files.read_claims(spark, str(tmp_path / "claims")).collect()}
    assert got == {("c1", "x1", "y1", 1, 2), ("c2", "x2", "y2", 3, 4)}
    (tmp_path / "curves").mkdir()
    (tmp_path / "curves" / "a.csv").write_text(",Trial,A,B\n1,1,0.5,0.25\n")
    (tmp_path / "curves" / "b.csv").write_text(",B,C,Trial\n1,0.75,0.1,2\n")
    got = {(r.Trial, r.A, r.B, r.C) for r in files.read_curves(spark, str(tmp_path / "curves")).collect()}
    assert got == {(1, 0.5, 0.25, None), (2, None, 0.75, 0.1)}
    (tmp_path / "sweep").mkdir()
    (tmp_path / "sweep" / "a.csv").write_text(",alpha,entropy_dist,bn_dist,ec_dist,rs_dist,rp_dist\n0,0.1,1,2,3,4,5\n")
    (tmp_path / "sweep" / "b.csv").write_text("rp_dist,alpha,Entropy.dist\n9,0.2,7\n")
    got = {(r.alpha, r.entropy_dist, r.rp_dist) for r in files.read_sweep(spark, str(tmp_path / "sweep")).collect()}
    assert got == {(0.1, 1.0, 5.0), (0.2, 7.0, 9.0)}
