"""Goldens of small grids, sources, formats and the command line."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathshade.functions.psi import Psi, parse_psi
from pathshade.functions.stats import normal_quantile, summary
from pathshade.functions.text import dataset_key, fnv1a_hex, log_choose, parse_bool, parse_int, parse_pairs, path_hash
from pathshade.operators import caps as cp
from pathshade.operators import lb3
from pathshade.operators import objectives as ob
from pathshade.operators import unions as un
from pathshade.operators.agents import parse_od
from pathshade.operators.greedy import brute_force, greedy, lazy_greedy, regular_spacing
from pathshade.operators.paths import distinct_paths, lattice_draws, path_lengths
from pathshade.operators.weights import SoftDecay, hard_weights, parse_soft_decay, soft_weights
from pathshade.plans.caches import Stale
from pathshade.plans.sandwich import Config, Sample, capped, certified, lower, proxy, report, report_tsv, routed, sandwich
from pathshade.sources import text as tx
from pathshade.sources.bundle import metadata_field, pack, read_bundle, read_bundle_sets, unpack, write_bundle
from pathshade.sources.grid import Grid, grid_edges, nodes, parse_grid


def candidates(spark, grid):
    return nodes(spark, grid).select(F.col("v").alias("u"), F.col("v").alias("cpos"))


def sample(spark, *paths):
    rows = [(0, p, i, v) for p, path in enumerate(paths) for i, v in enumerate(path)]
    nodes_ = spark.createDataFrame(rows, "agent long, path long, pos long, v long")
    return Sample(nodes_, path_lengths(nodes_))


def ids(objective, k):
    return [u for u, _ in greedy(objective, k)]


@pytest.fixture(scope="module")
def square(spark):
    g = Grid(2, 2)
    return hard_weights(grid_edges(spark, g), candidates(spark, g), 1).cache(), sample(spark, [0, 1, 3], [0, 2, 3])


def test_golden_square(spark, square):
    w, s = square
    c = Config(k=2, lam=0.5)
    up = certified(w, s, c)
    assert {r.v: r.c for r in up.coef.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert ids(up, 2) == [0, 1] and up.value([0, 1]).first()[0] == 3.0
    pr = proxy(w, s, c, 2)
    assert ids(pr, 2) == [1, 0] and pr.value([1, 0]).first()[0] == 4.0
    lb1 = lower(w, s, c)
    assert ids(lb1, 2) == [1] and lb1.value([1]).first()[0] == 2.0
    lb2 = lower(w, s, Config(k=2, lam=0.5, lb="uniform"))
    assert ids(lb2, 2) == [1, 0] and lb2.value([1, 0]).first()[0] == 2.0
    for mode in ("pathlen", "topk", "global"):
        assert cp.caps(mode, s.paths, s.path_nodes, w, c.psi, 2).first().cap == 3.0
    cap, mode = capped(w, s, c)
    assert mode == "pathlen" and ids(cap, 2) == [0] and cap.value([0]).first()[0] == 2.0
    f = ob.Original(w, s.path_nodes, s.paths, c.psi, 0.5)
    assert f.value([0, 1]).first()[0] == f.value([1]).first()[0] == 2.0
    out = sandwich(spark, w, s, c)
    assert out["picked"] == "UB" and out["S_pick"] == [0, 1]
    text = report_tsv(report(out, [("tag", "x"), ("k", "2")]))
    assert text.startswith("tag\tx\nk\t2\n\npick\tBEGIN\npick\tS\t0 1\n") and text.endswith("LB\tM\t1\nLB\tEND\n")


def test_golden_line(spark):
    g = Grid(1, 3)
    w, s = hard_weights(grid_edges(spark, g), candidates(spark, g), 1), sample(spark, [0, 1, 2])
    c = Config(k=2, lam=0.5)
    for o in (certified(w, s, c), proxy(w, s, c, 2), lower(w, s, c), capped(w, s, c)[0]):
        assert ids(o, 2) == [1] and o.value([1]).first()[0] == 2.0


def test_golden_soft_pick_is_the_lower_bound(spark):
    g = Grid(2, 2)
    w = soft_weights(grid_edges(spark, g), candidates(spark, g), SoftDecay(1.0, 1, 0.0)).cache()
    s = sample(spark, [0, 1, 3], [0, 2, 3])
    c = Config(k=2, lam=0.5, psi=Psi("log1p", 0.0))
    close = lambda x: pytest.approx(x, abs=1e-6)
    for o, picks, value in ((certified(w, s, c), [0, 3], 1.489184), (proxy(w, s, c, 2), [0, 3], 1.875478), (lower(w, s, c), [1, 0], 1.037251), (lower(w, s, Config(k=2, lam=0.5, psi=c.psi, lb="uniform")), [0, 3], 0.937739)):
        assert ids(o, 2) == picks and o.value(picks).first()[0] == close(value)
    assert cp.caps("topk", s.paths, s.path_nodes, w, c.psi, 2).first().cap == close(2.585984)
    assert cp.caps("global", s.paths, s.path_nodes, w, c.psi, 2).first().cap == close(3.019227)
    out = sandwich(spark, w, s, c)
    assert out["picked"] == "LB" and out["F_UB"] == close(0.937739) and out["F_LB"] == close(1.037251)


def test_bounds_hold(spark):
    g = Grid(4, 4)
    w = hard_weights(grid_edges(spark, g), candidates(spark, g), 1).cache()
    agents = spark.createDataFrame([(i, (i * 5) % 16, (i * 11 + 3) % 16) for i in range(12) if (i * 5) % 16 != (i * 11 + 3) % 16], "agent long, s long, t long")
    pn = distinct_paths(lattice_draws(agents, 4, 6), 3).cache()
    s = Sample(pn, path_lengths(pn))
    for picked in ([0], [5, 10], [1, 6, 11]):
        c = Config(k=3, lam=0.2)
        f = ob.Original(w, s.path_nodes, s.paths, c.psi, c.lam).value(picked).first()[0]
        assert lower(w, s, c).value(picked).first()[0] <= f + 1e-9
        assert f <= capped(w, s, c)[0].value(picked).first()[0] + 1e-9 <= certified(w, s, c).value(picked).first()[0] + 2e-9
    o = certified(w, s, Config())
    assert lazy_greedy(o, 3) == greedy(o, 3)
    best = brute_force(w, candidates(spark, g), o.coef, o.psi, 2).agg(F.max("value")).first()[0]
    gained = sum(x for _, x in greedy(o, 2))
    assert (1 - 1 / math.e) * best - 1e-6 <= gained <= best + 1e-6
    with pytest.raises(ValueError):
        brute_force(w, candidates(spark, g), o.coef, o.psi, 3, guard=10)
    one, summed = routed(Config(ub_mode="ProxyCorridor", corridor_r=1), s), routed(Config(ub_mode="SumDeprecated"), s)
    assert one.mode == "CertifiedUnion" and one.one and summed.mode == "ProxyCorridor" and summed.summed and summed.r == 3


def test_psi():
    assert [parse_psi(x).kind for x in ("CLIP:1.0", "expsat:2", "log1p", "power:0.5")] == ["clip", "expsat", "log1p", "power"]
    for bad in ("clip:0", "clip", "power:1.5", "sqrt:1", "expsat:-1", "log1p:2", "clip:nan"):
        with pytest.raises(ValueError):
            parse_psi(bad)
    assert Psi("clip", 2).bound == 2 and Psi("expsat", 3).bound == 1 and not Psi("log1p").bounded
    assert Psi("power", 0.5).value(-1) == 0 and Psi("power", 0.5).value(4) == 2


def test_psi_columns(spark):
    t = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (3.0,)], ["t"])
    for p in (Psi("clip", 1.5), Psi("log1p"), Psi("expsat", 0.7), Psi("power", 0.5)):
        for r in t.select("t", p(F.col("t")).alias("x")).collect():
            assert r.x == pytest.approx(p.value(r.t))


def test_statistics(spark):
    assert normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6) and normal_quantile(0) == -math.inf
    one = summary(spark.createDataFrame([(3.0,)], ["x"]), "x").first()
    assert (one["mean"], one["var"], one["se"], one.ci_low, one.ci_high, one.m) == (3, 0, 0, 3, 3, 1)
    none = summary(spark.createDataFrame([], "x double"), "x").first()
    assert (none["mean"], none["var"], none["se"], none.m) == (0, 0, 0, 0)


def test_option_values():
    assert parse_int(" -3") == -3 and parse_bool("True") and not parse_bool("0")
    for bad in ("3x", "", "1.5"):
        with pytest.raises(ValueError):
            parse_int(bad)
    with pytest.raises(ValueError):
        parse_bool("yes")
    assert parse_pairs("K=5, seed=7") == {"k": "5", "seed": "7"}
    with pytest.raises(ValueError):
        parse_pairs("k")
    assert fnv1a_hex(b"a") == "af63dc4c8601ec8c" and dataset_key({"edges": "x/my-city 2.txt"}) == ("MY_CITY_2", "edges")
    assert log_choose(5, 2) == pytest.approx(math.log(10)) and log_choose(5, 6) == log_choose(5, -1) == -1e300 and log_choose(4, 0) == 0
    assert [parse_od(x) for x in ("", "HotspotMixture", "Gravity")] == ["uniform", "hotspot", "gravity"]
    assert path_hash([1, 2]) != path_hash([2, 1])
    assert parse_soft_decay("gauss:1").radius == 3 and parse_soft_decay("exp:0.5:3:0.01") == SoftDecay(0.5, 3, 0.01)
    with pytest.raises(ValueError):
        parse_soft_decay("exp:1")
    assert parse_grid("rows=3,cols=4,diag=1").offsets.__len__() == 8
    for bad in ("rows=0,cols=1", "rows=1,cols=2,x=1"):
        with pytest.raises(ValueError):
            parse_grid(bad)
    assert tx.parse_hotspots("0:3,7:1") == [(0, 3.0), (7, 1.0)]
    for bad in ("", "3", "1:0"):
        with pytest.raises(ValueError):
            tx.parse_hotspots(bad)


def test_text_files(spark, tmp_path):
    f = tmp_path / "edges.txt"
    f.write_text("# head\n\n1 2 tail\n2 1\n3 3\nx y\n4\n9 1\n  2   3\n")
    got = sorted(tuple(r) for r in tx.edges_of(tx.read_lines(spark, str(f)), n=4, undirected=True, one_based=True).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (1, 0), (1, 2), (2, 1), (2, 2), (2, 2)]
    assert len(tx.edges_of(tx.read_lines(spark, str(f)), n=4, one_based=True, distinct=True).collect()) == 5
    c = tmp_path / "c.txt"
    c.write_text("5\n3\n5\n99\n\n# 4\n0\n")
    assert [tuple(r) for r in tx.ids_of(tx.read_lines(spark, str(c)), 10).orderBy("cpos").collect()] == [(5, 0), (3, 1), (0, 2)]
    p = tmp_path / "p.txt"
    p.write_text("0 1 2 | 0 9\n7\n1 2|2 x|2 1\n")
    got = [tuple(r) for r in tx.paths_of(tx.read_lines(spark, str(p)), 9).select("path", "pos", "v").orderBy("agent", "path", "pos").collect()]
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 0, 1), (0, 1, 2), (2, 0, 2), (2, 1, 1)]
    h = tmp_path / "h.txt"
    h.write_text("3 1.5\n4 -1\n")
    with pytest.raises(Exception, match="hotspot"):
        tx.hotspots_of(tx.read_lines(spark, str(h))).collect()


def test_grids(spark):
    assert grid_edges(spark, Grid(3, 4)).count() == 2 * (3 * 3 + 2 * 4)
    assert grid_edges(spark, Grid(3, 3, torus=True)).count() == 36
    loops = grid_edges(spark, Grid(1, 2, torus=True))
    assert loops.where("u = v").count() == 4 and tx.canonical(loops).count() == 1
    assert sorted(r.v for r in regular_spacing(nodes(spark, Grid(4, 4)), 4, 4, 4).collect()) == [5, 7, 13, 15]


def test_lattice_draws_are_shortest_and_uniform(spark):
    agents = spark.createDataFrame([(0, 0, 8), (1, 8, 0), (2, 2, 6), (3, 0, 2)], "agent long, s long, t long")
    draws = lattice_draws(agents, 3, 600).cache()
    nodes_ = draws.groupBy("agent", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("p"))
    counts = {}
    for r in nodes_.collect():
        assert all(abs(a - b) in (1, 3) for a, b in zip(r.p, r.p[1:]))
        counts.setdefault(r.agent, {}).setdefault(tuple(r.p), 0)
        counts[r.agent][tuple(r.p)] += 1
    assert len(counts[0]) == 6 and len(counts[3]) == 1
    assert max(counts[0].values()) < 150 and min(counts[0].values()) > 60
    stats = {r.v: r for r in un.corridor_stats(draws.where("agent = 3"), 2).collect()}
    assert stats[1].b_r == 2 and stats[1].c_total == 600


def test_bundles(spark, tmp_path):
    u, v = np.array([0, 0, 2, 1]), np.array([1, 2, 0, 1])
    data = pack(u, v, 3, [0, 2], [1], meta={"note": "x"})
    g = unpack(data)
    assert list(zip(g["u"], g["v"])) == [(0, 1), (0, 2), (1, 1), (2, 0)] and list(g["candidates"]) == [0, 2] and list(g["blocked"]) == [1] and g["meta"]["note"] == "x"
    for bad in (b"", data[:-1], b"X" + data[1:], data[:8] + b"\x09" + data[9:]):
        with pytest.raises(ValueError):
            unpack(bad)
    wrong = bytearray(data)
    wrong[60 + 8 * 4] = 7
    with pytest.raises(ValueError, match="range"):
        unpack(bytes(wrong))
    path = str(tmp_path / "g.gbin")
    write_bundle(spark, grid_edges(spark, Grid(2, 3)), path, 6)
    assert sorted(map(tuple, read_bundle(spark, path).collect())) == sorted(map(tuple, grid_edges(spark, Grid(2, 3)).collect()))


def test_command_line(spark, tmp_path):
    from pathshade.plans.cli import main

    base = ["--make_grid", "rows=5,cols=5", "--hard_cutoff", "1", "--k", "2", "--M_agents", "15", "--K_paths_per_agent", "2", "--out_dir", str(tmp_path), "--lambda", "0.1"]
    out = main([*base, "--tag", "a"], spark)
    assert len(out["S_pick"]) == 2 and (tmp_path / "a" / "run_config.json").exists()
    report_ = dict(x.split("\t", 1) for x in (tmp_path / "a" / "report.tsv").read_text().split("\n\n")[0].splitlines())
    assert report_["tag"] == "a" and report_["M_agents"] == "15" and report_["selection_mode_effective"] == "CertifiedUnion" and report_["od_params_json"] == "{}" and report_["blocked_source"] == "<none>"
    assert len(report_) >= 80 and float(report_["avg_agents_per_node"]) > 0 and report_["lambda"] == "0.100000" and report_["cap_cache"] == "true"
    assert (tmp_path / "a" / "solution.txt").read_text().splitlines()[3] == " ".join(map(str, out["S_pick"]))
    assert "selection_time" in (tmp_path / "a" / "stdout.txt").read_text()
    spaced = main([*base, "--tag", "b", "--method", "regular_spacing_grid", "--margs", "k=3"], spark)
    assert len(spaced["S_pick"]) == 3
    assert main([*base, "--dry_run", "1"], spark)["n"] == 25
    assert main(["--list-methods"], spark) == {}
    many = main([*base, "--tag", "c", "--ub_mode", "CappedUnion", "--cap_mode", "TopkLocal", "--use_LB3_iter", "1", "--lb3_max_iters", "2", "--corridor_r", "3", "--save_weights", "1", "--weights_bin", str(tmp_path / "w"), "--M_eval", "10", "--reuse_eval_samples", "0", "--log_level", "debug", "--json_meta", str(tmp_path / "c.json")], spark)
    assert many["lb3_run_mode"] == "iter" and 1 <= many["lb3_iters_done"] <= 2 and many["cap_max"] > 0 and many["stats_UB"]["m"] == 10 and (tmp_path / "c.json").exists()
    assert "dataset_summary: nodes=25, edges=40" in (tmp_path / "c" / "stdout.txt").read_text()
    again = ["--make_grid", "rows=5,cols=5", "--k", "2", "--M_agents", "15", "--out_dir", str(tmp_path), "--load_weights", "1", "--weights_bin", str(tmp_path / "w"), "--method", "random_k"]
    assert len(main([*again, "--corridor_band_r", "1"], spark)["S_pick"]) == 2
    with pytest.raises(Stale):
        main([*again, "--hard_cutoff", "2"], spark)
    (tmp_path / "empty.txt").write_text("# none\n")
    with pytest.raises(ValueError, match="no valid"):
        main([*base, "--blocked", str(tmp_path / "empty.txt")], spark)
    (tmp_path / "blocked.txt").write_text("3\n99\n")
    (tmp_path / "blocked_meta.json").write_text('{"blocked_source": "survey", "blocked_seed": 5, "blocked_fraction": "x"}')
    main([*base, "--tag", "d", "--blocked", str(tmp_path / "blocked.txt"), "--method", "static_com_greedy", "--od_dist", "hotspot", "--od_hotspots", "0:1,24:2,12:1"], spark)
    text = (tmp_path / "d" / "report.tsv").read_text()
    assert "blocked_count\t1\n" in text and "blocked_source\tsurvey\n" in text and "blocked_seed\t5\n" in text and "blocked_fraction" not in text and 'od_params_json\t{"hotspots":[[0,1.000000],[24,2.000000],[12,1.000000]]}' in text
    for bad in (["--k", "2"], [*base, "--soft_decay", "gauss:1"], ["--make_grid", "rows=2,cols=2"], [*base, "--od_dist", "hotspot"]):
        with pytest.raises(SystemExit):
            main(bad, spark)


def test_tiny_gains_are_gains(spark):
    g = Grid(1, 3)
    w = hard_weights(grid_edges(spark, g), candidates(spark, g), 0)
    small = ob.Linear(w, spark.createDataFrame([(0, 1e-8), (1, 3e-8), (2, 0.0)], "v long, c double"), Psi("clip", 1.0))
    assert [u for u, _ in greedy(small, 3)] == [1, 0]


def brute_original(weights, paths, psi, lam, picked):
    m = {}
    for u, v, x in weights:
        if u in picked:
            m[v] = m.get(v, 0.0) + x
    return sum(max(sum(psi.value(m.get(v, 0.0)) for v in p) - lam * (len(p) - 1) for p in ps) for ps in paths.values())


def test_lazy_greedy_and_gains_of_the_original(spark):
    g, rng = Grid(3, 4), np.random.default_rng(3)
    w = soft_weights(grid_edges(spark, g), candidates(spark, g), SoftDecay(0.7, 2, 0.0)).cache()
    agents = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (9, 2))) if a != b], "agent long, s long, t long")
    pn = distinct_paths(lattice_draws(agents, 4, 5), 3).cache()
    o = ob.Original(w, pn, path_lengths(pn), Psi("log1p"), 0.3)
    rows = [(r.u, r.v, r.w) for r in w.collect()]
    paths = {}
    for r in pn.orderBy("agent", "path", "pos").collect():
        paths.setdefault(r.agent, {}).setdefault(r.path, []).append(r.v)
    paths = {a: list(p.values()) for a, p in paths.items()}
    f = lambda s: brute_original(rows, paths, o.psi, o.lam, s)
    gain = {r.u: r.gain for r in o.gains([5]).collect()}
    assert all(gain.get(u, 0.0) == pytest.approx(f([5, u]) - f([5]), abs=1e-9) for u in range(12) if u != 5)
    assert o.value([5, 2]).first()[0] == pytest.approx(f([5, 2]))
    stale, picked, want = {u: f([u]) - f([]) for u in range(12)}, [], []
    while len(want) < 4:  # one stale candidate is looked at again at a time
        fresh = set(range(12)) if not picked else set()
        while (best := min(stale, key=lambda u: (-round(stale[u], 6), u))) not in fresh:
            stale[best] = f([*picked, best]) - f(picked)
            fresh.add(best)
        if stale[best] < 1e-12:
            break
        stale.pop(best)
        picked.append(best)
        want.append(best)
    assert [u for u, _ in lazy_greedy(o, 4, batch=1)] == want


def test_lb3_stops_when_two_rounds_agree(spark):
    g = Grid(2, 3)
    w, s = hard_weights(grid_edges(spark, g), candidates(spark, g), 1).cache(), sample(spark, [0, 1, 2, 5], [0, 3, 4, 5])
    o = ob.Original(w, s.path_nodes, s.paths, Psi("clip", 1.0), 0.1)
    out = lb3.iterate(o, [], 2, rounds=6)
    assert 2 <= out.rounds < 6 and out.value == pytest.approx(o.value(out.picked).first()[0])
    assert lb3.iterate(o, out.picked, 2, rounds=6).rounds == 1
    assert lb3.iterate(o, out.picked, 2, rounds=3, exact_rounds=True).rounds == 3
    assert lb3.iterate(o, [5], 1, rounds=1).picked == [u for u, _ in greedy(lb3.linearised(o, [5], 1.0), 1)]  # the first round replaces the start


def test_scratch_is_of_one_thread(spark):
    from threading import Thread

    from pathshade.session import delete, scratch, shared_dir, written

    df = spark.range(3)
    with scratch() as outer:
        with scratch() as inner:
            table = written(df)
        other = Thread(target=written, args=(df,))
        other.start()
        other.join()
        written(df)
    written(df)
    assert len(inner) == 1 and len(outer) == 2 and outer[0] == inner[0] and outer[0].startswith(shared_dir(spark))
    assert table.count() == 3
    delete(spark, inner[0])
    assert not os.path.exists(inner[0].removeprefix("file:"))


def test_searches_end_early_and_agree(spark):
    from pathshade.operators import graph as gr

    rng = np.random.default_rng(5)
    one_way = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (110, 2))], "u long, v long").cache()
    two_way = one_way.union(one_way.select("v", "u")).cache()
    agents = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 70, (25, 2)))], "agent long, s long, t long")

    def distances(edges):
        near = {}
        for r in edges.collect():
            near.setdefault(r.u, set()).add(r.v)
        out = {}
        for s in range(70):
            out[s], todo = {s: 0}, [s]
            while todo:
                todo = [(out[s].setdefault(v, out[s][u] + 1), v)[1] for u in todo for v in near.get(u, ()) if v not in out[s]]
        return out

    for edges, symmetric in ((one_way, False), (two_way, True), (two_way, False)):
        d, rows = distances(edges), agents.collect()
        got = {(r.src, r.v): r.d for r in gr.hops(edges, agents.select(F.col("s").alias("src")).distinct(), symmetric=symmetric).collect()}
        assert got == {(r.s, v): x for r in rows for v, x in d[r.s].items()}
        assert {r.agent for r in gr.reachable(edges, agents, symmetric).collect()} == {r.agent for r in rows if r.t in d[r.s]}
        want = sorted((r.agent, e.u, e.v, d[r.s][e.u]) for r in rows if r.t in d[r.s] for e in edges.collect() if e.u in d[r.s] and r.t in d[e.v] and d[r.s][e.u] + 1 + d[e.v][r.t] == d[r.s][r.t])
        assert sorted(map(tuple, gr.shortest_path_dag(edges, agents, symmetric=symmetric).collect())) == want


def test_hotspots_that_are_all_blocked_give_no_pairs(spark):
    from pathshade.operators.agents import OD, sample_od

    attempts, walk = spark.range(4).withColumnRenamed("id", "attempt"), spark.range(9).withColumnRenamed("id", "v")
    hot = spark.createDataFrame([(0, 3.0), (8, 1.0)], "node long, weight double")
    got = sample_od(attempts, walk, OD("hotspot"), hotspots=hot, blocked=walk)
    assert got.columns == ["attempt", "s", "t", "try"] and got.collect() == []
    some = sample_od(attempts, walk, OD("hotspot"), hotspots=hot, blocked=walk.where("v = 4")).collect()
    assert len(some) == 4 and all({r.s, r.t} == {0, 8} for r in some)
    assert sample_od(attempts, walk, OD("hotspot"), hotspots=hot.where("weight < 0")).collect() == []


@pytest.mark.parametrize("few", [0, 500_000])
def test_tries_are_never_broadcast(spark, monkeypatch, few):
    from pathshade.operators import agents as ag

    attempts, walk = spark.range(300).withColumnRenamed("id", "attempt"), spark.range(256).withColumnRenamed("id", "v")
    od = ag.OD("gaussian", sigma=1.5, rows=16, cols=16)
    want = sorted(map(tuple, ag.sample_od(attempts, walk, od, tries=12).collect()))
    monkeypatch.setattr(ag, "FEW", few)
    got = ag.sample_od(attempts, walk, od, tries=12)
    joins = [x for x in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [_i#" in x]
    assert len(joins) == 1 and ("BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0] if few else "SortMergeJoin" in joins[0])
    assert sorted(map(tuple, got.collect())) == want and len(want) == 300


FAR_APART = {
    "shortest_path_dag": lambda gr, pt, one_way, edges, agents: gr.shortest_path_dag(edges, agents, symmetric=True),
    "corridor": lambda gr, pt, one_way, edges, agents: gr.corridor(edges, agents, 1, True),
    "reachable": lambda gr, pt, one_way, edges, agents: gr.reachable(one_way, agents),
    "dag_counts": lambda gr, pt, one_way, edges, agents: pt.dag_counts(gr.shortest_path_dag(edges, agents, symmetric=True), agents),
    "dag_draws": lambda gr, pt, one_way, edges, agents: pt.dag_draws(dag := gr.shortest_path_dag(edges, agents, symmetric=True), pt.dag_counts(dag, agents), agents, 2),
}


@pytest.mark.parametrize("name", FAR_APART)
def test_searches_from_both_ends_stay_small(spark, name):
    from pathshade.operators import graph as gr
    from pathshade.operators import paths as pt
    from pathshade.session import scratch

    rng = np.random.default_rng(8)
    one_way = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 3000, (15000, 2))], "u long, v long").cache()
    edges = one_way.union(one_way.select("v", "u")).cache()
    agents = spark.createDataFrame([(i, i, i * 17 + 1500) for i in range(6)], "agent long, s long, t long")
    with scratch() as tables:
        found = FAR_APART[name](gr, pt, one_way, edges, agents)
        assert {r.agent for r in found.select("agent").distinct().collect()} == set(range(6))
    seen = sum(spark.read.parquet(x).count() for x in tables if "/frontier-" in x)
    assert 12 <= seen < 6000  # from one end a search sees most of the 3000 nodes


BROADCAST = {
    "corridor": lambda gr, pt, edges, agents, both: gr.corridor(edges, agents, 1, both),
    "shortest_path_dag": lambda gr, pt, edges, agents, both: gr.shortest_path_dag(edges, agents, symmetric=both),
    "reachable": lambda gr, pt, edges, agents, both: gr.reachable(edges, agents, both).select("agent", "s", "t"),
    "shortest_counts": lambda gr, pt, edges, agents, both: pt.shortest_counts(edges, agents, both),
    "shortest_draws": lambda gr, pt, edges, agents, both: pt.shortest_draws(edges, agents, 3, 5, both),
}


@pytest.mark.parametrize("name", BROADCAST)
def test_searches_of_a_broadcast_graph_agree_and_write_no_levels(spark, monkeypatch, name):
    from pathshade.operators import csr
    from pathshade.operators import graph as gr
    from pathshade.operators import paths as pt
    from pathshade.session import scratch

    rng = np.random.default_rng(11)
    one_way = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 90, (450, 2))], "u long, v long").cache()
    edges = {False: one_way, True: one_way.union(one_way.select("v", "u")).cache()}
    pairs = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 100, (60, 2)))]  # some without edges
    agents = spark.createDataFrame([*pairs, (60, 3, 3), (61, 95, 95), (62, 97, 2), *[(70 + i, *pairs[0][1:]) for i in range(9)]], "agent long, s long, t long").cache()
    monkeypatch.setattr(csr, "PIECE", 50)
    for both, e in edges.items():
        got = {}
        for size in (2**27, 0):
            monkeypatch.setattr(csr, "BYTES", size)
            with scratch() as tables:
                got[size] = sorted(map(tuple, BROADCAST[name](gr, pt, e, agents, both).collect()))
            assert any("/frontier-" in x for x in tables) == (not size)
        assert got[2**27] == got[0] and len(got[0]) > 40


@pytest.mark.parametrize("kind", ["original", "capped"])
def test_dense_rounds_agree_with_joins(spark, monkeypatch, kind):
    from pathshade.operators import dense

    g = Grid(5, 5)
    few = candidates(spark, g).where("u % 2 = 0")  # nodes that nothing reaches, too
    w = soft_weights(grid_edges(spark, g), few.where("u < 16"), SoftDecay(0.7, 2)).cache()
    rng = np.random.default_rng(3)
    rows = [(a, p, i, int(v)) for a in range(40) for p in range(1 + a % 4) for i, v in enumerate(rng.integers(0, 25, rng.integers(1, 7)))]  # some visit a node twice
    pn = spark.createDataFrame(rows, "agent long, path long, pos long, v long").cache()
    pl, psi, made = path_lengths(pn), Psi("log1p"), []
    monkeypatch.setattr(dense, "BLOCK", 3)
    for cells in (2**18, 0):
        monkeypatch.setattr(dense, "CELLS", cells)
        caps = cp.caps("topk", pl, pn, w, psi, 1).where("agent <> 7").cache()
        o = ob.Original(w, pn, pl, psi, 0.3) if kind == "original" else ob.Capped(w, un.agent_nodes(pn), caps, psi)
        assert (o.agents is None) == (cells == 0)
        found = [sorted((r.u, r.cpos, round(r.gain, 9)) for r in o.gains(s).collect()) for s in ([], [0], [0, 12, 6])]
        made.append((found, greedy(o, 4)))
    assert made[0][0] == made[1][0] and len(made[0][0][0]) > 5
    assert [(u, round(x, 9)) for u, x in made[0][1]] == [(u, round(x, 9)) for u, x in made[1][1]]


def test_original_method_makes_no_row_a_weight(spark, monkeypatch):
    from pathshade.plans.methods import Context, run

    g = Grid(4, 4)
    w = soft_weights(grid_edges(spark, g), candidates(spark, g), SoftDecay(0.5, 2)).cache()
    agents = spark.createDataFrame([(i, (i * 5) % 16, (i * 11 + 3) % 16) for i in range(12) if (i * 5) % 16 != (i * 11 + 3) % 16], "agent long, s long, t long")
    pn = distinct_paths(lattice_draws(agents, 4, 6), 3).cache()
    s = Sample(pn, path_lengths(pn))
    want = ids(ob.Original(w, pn, s.paths, Psi("log1p"), 0.25), 2)
    monkeypatch.setattr(ob.Original, "scored", None)  # the rows that weights are joined with
    assert run("greedy_original_full", Context(spark, w, candidates(spark, g), nodes(spark, g), s, Config(k=2, psi=Psi("log1p"), lam=0.25)))["S_pick"] == want


@pytest.mark.parametrize("cap_mode", ["TopkLocal", "GlobalAll", "PathlenOnly"])
def test_methods_on_packed_lattice_paths_write_no_path_nodes(spark, monkeypatch, cap_mode):
    from pathshade.operators import paths as pt
    from pathshade.plans.methods import Context, run

    g = Grid(5, 4)
    w = soft_weights(grid_edges(spark, g), candidates(spark, g), SoftDecay(0.5, 2)).cache()
    agents = spark.createDataFrame([(a, a * 7 % 20, a * 3 % 19) for a in range(90)], "agent long, s long, t long").cache()  # some stay
    pn = lattice_draws(agents, 4, 3, 9).cache()
    monkeypatch.setattr(pt, "SHARE", 20)
    packed = pt.lattice_packed(agents, 4, 3, 9).cache()
    own = {}
    for r in pn.orderBy("agent", "path", "pos").collect():
        own.setdefault(r.agent, {}).setdefault(r.path, []).append(r.v)
    assert {r.agent: (r.lens, r.nodes) for r in packed.collect()} == {a: ([len(x) for x in p.values()], sum(p.values(), [])) for a, p in own.items()}
    never = F.raise_error(F.lit("read")).cast("long")
    hidden = pn.withColumns({c: never for c in pn.columns})
    psi = Psi("clip", 1.0) if cap_mode == "PathlenOnly" else Psi("log1p")
    made = []
    for x in (Sample(pn, path_lengths(pn)), Sample(hidden, path_lengths(hidden), packed=packed)):
        out = run("greedy_original_full", Context(spark, w, candidates(spark, g), nodes(spark, g), x, Config(k=2, psi=psi, lam=0.25)), f"cap_mode={cap_mode}")
        made.append({k: v if isinstance(v, str | list | dict) else round(v, 9) for k, v in out.items() if "time" not in k and k != "gains" and not k.startswith("stats")} | {"mean": round(out["stats_pick"]["mean"], 9)})
    assert made[0] == made[1] and len(made[0]["S_pick"]) == 2


def test_smart_places_copy_inputs(spark, tmp_path, monkeypatch):
    from pathshade.plans.cli import main
    from pathshade.plans.locations import copy, located, on_disk

    source = tmp_path / "lyon" / "edges.txt"
    source.parent.mkdir()
    source.write_text("0 1\n1 2\n")
    after, copies, log = located({"paths_mode": "smart", "edges": str(source), "pack_blocked": str(tmp_path / "none"), "out_dir": "data"}, on_disk(spark))
    assert after["edges"] == "data/datasets/LYON/edges.txt" and after["out_dir"] == "data/experiments/LYON" and after["pack_blocked"].endswith("none") and len(copies) == 1 and log
    copy(spark, str(source), str(tmp_path / "copied" / "edges.txt"))
    assert (tmp_path / "copied" / "edges.txt").read_text() == "0 1\n1 2\n"
    out = main(["--edges", str(source), "--hard_cutoff", "1", "--dry_run", "1", "--out_dir", str(tmp_path), "--dataset_key", "my key"], spark)
    assert out["dataset_key"] == "MY_KEY" and out["n"] == 3


def test_bundle_metadata(spark, tmp_path):
    path = str(tmp_path / "g.gbin")
    shut = spark.createDataFrame([(2,)], "v long")
    write_bundle(spark, grid_edges(spark, Grid(2, 3)), path, 6, blocked=shut, meta={"note": "n", "blocked_seed": 4})
    text = (tmp_path / "g.gbin.json").read_text()
    assert metadata_field(text, "blocked_count", int) == 1 and metadata_field(text, "note", str) == "n" and metadata_field(text, "n", int) == 6 and metadata_field(text, "blocked_seed", int) == 4
    assert metadata_field(text, "note", int, -1) == -1 and metadata_field('{"blocked_src": "old"}', "blocked_source", str) == "old" and len(metadata_field(text, "hash_edges", str)) >= 15
    assert read_bundle_sets(spark, path)["meta"]["blocked_count"] == 1


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["grid_edge_list", "edge_text_scan", "candidate_dedup", "bfs_distances", "shortest_path_dag", "corridor_band", "weights_sparse", "psi_power", "od_gravity", "od_hotspot", "k_distinct_paths", "dag_path_sample", "corridor_stats", "marginals_capped", "marginals_original", "softmax_mixture", "eval_stats", "lb3_iterate", "sandwich_report", "method_random_k", "option_values", "solution_file", "weights_cache", "weights_fingerprint", "lattice_log_counts", "blocked_metadata"])
def test_oracles(spark, name):
    import duckdb

    from pathshade.plans import catalog

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    fix = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    want = sorted((tuple(fix(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(fix(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_every_query_has_an_oracle_or_a_reason():
    from pathshade.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES)
