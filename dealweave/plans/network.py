"""Queries over the co-investment graph: structure, centrality, communities, scores, link prediction, diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.operators import deals as deal_ops
from dealweave.operators import diffusion, graph, linkpred, paths, prescience
from dealweave.operators.ranking import placed
from dealweave.plans import adapter as a
from dealweave.plans.adapter import BASE, DEALS, NODES, QUARTERS, UND, sql
from dealweave.session import dropped, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph as a table, made in steps, so the shuffle files of one are gone before those of the next."""
    deals = written(a.deals(spark, d).select("company_name", "funding_round_type", "investor_name", "funded_at"), "deals")
    edges = written(deal_ops.temporal_edges(deals).select("source", "target", "weight"), "edges")
    dropped(deals)
    g = written(deal_ops.assemble(edges), "graph")
    dropped(edges)
    return g


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(sql(DEALS, "select company_name, funding_round_type, min(funded_at) as round_date, array_to_string(list_sort(list(distinct investor_name)), '|') as investors from deals group by 1, 2"))
def deals_rounds(spark: SparkSession, d: str) -> DataFrame:
    return deal_ops.round_table(a.deals(spark, d)).withColumn("investors", F.array_join("investors", "|"))


@query(sql(DEALS, a.EDGES, "select source, target, company, round(weight, 6) as weight, round(gap, 3) as round_gap_years, source_round, target_round, source_date, target_date from edges"))
def gra_edges(spark: SparkSession, d: str) -> DataFrame:
    return _r(deal_ops.validate_edges(a.edges(spark, d)), "weight")


@query(sql(*BASE, "select * from graph"))
def gra_assemble(spark: SparkSession, d: str) -> DataFrame:
    return a.graph(spark, d)


@query(sql(*BASE, UND, "select a, b, round(weight, 6) as weight from und"))
def gra_undirected(spark: SparkSession, d: str) -> DataFrame:
    return _r(deal_ops.undirected(a.graph(spark, d)), "weight")


@query(sql(*BASE, NODES, "select node, out_degree, in_degree, degree, round(out_weight, 4) as out_weight, round(in_weight, 4) as in_weight from deg"))
def gra_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.degrees(a.graph(spark, d)), "out_weight", "in_weight", digits=4)


@query(sql(*BASE, NODES, "select node, round(in_degree / (n - 1), 9) as in_centrality, round(out_degree / (n - 1), 9) as out_centrality, round(degree / (n - 1), 9) as centrality from deg, (select count(*)::double as n from deg)"))
def gra_degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.degree_centrality(a.graph(spark, d)), "in_centrality", "out_centrality", "centrality", digits=9)


@query(
    sql(*BASE, NODES, """select n as n_nodes, m as n_edges, round(m / (n * (n - 1)), 9) as density, round(mutual / m, 9) as reciprocity, round(md, 6) as mean_degree, xd as max_degree
    from (select count(*) as n, avg(degree) as md, max(degree) as xd from deg), (select count(*) as m from graph),
         (select count(*) as mutual from graph g semi join (select dst as src, src as dst from graph) h using (src, dst))""")
)
def gra_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(graph.summary(written(a.graph(spark, d), "graph")), "density", "reciprocity", digits=9), "mean_degree")


@query(
    sql(*BASE, UND, """both_ as (select a as x, b as y from und union all select b, a from und),
k as (select x, count(*) as k from both_ group by 1),
t as (select p.x, count(*) / 2 as t from both_ p join both_ q on p.x = q.x and p.y <> q.y join both_ r on r.x = p.y and r.y = q.y group by 1)
select round(avg(coalesce(c, 0)), 6) as average_all, round(avg(c), 6) as average_from_two, round(sum(2 * t) / sum(k * (k - 1)), 6) as transitivity
from (select k, coalesce(t, 0) as t, case when k > 1 then 2 * coalesce(t, 0) / (k * (k - 1)) end as c from k left join t using (x))""")
)
def gra_clustering(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.clustering(deal_ops.undirected(a.graph(spark, d))), "average_all", "average_from_two", "transitivity")


@query(sql(*BASE, NODES, "select round(corr(s.out_degree, t.in_degree), 6) as assortativity from graph join deg s on s.node = src join deg t on t.node = dst"))
def gra_assortativity(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.assortativity(a.graph(spark, d)), "assortativity")


@query(sql(*BASE, NODES, "select round(-sum(p * log2(p)), 6) as entropy_bits from (select count(*) / sum(count(*)) over () as p from deg group by degree)"))
def gra_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _r(graph.degree_entropy(a.graph(spark, d)), "entropy_bits")


@query(sql(*BASE, NODES, "select least(floor((degree - lo) / greatest((hi - lo) / 30.0::double, 1e-9)), 29)::int as bin, count(*) as n from deg, (select min(degree) as lo, max(degree) as hi from deg) group by 1"))
def gra_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(a.graph(spark, d))


@query(sql(DEALS, a.EDGES, "select target as neighbour, 'out' as direction, count(*) as n_deals from edges where source = 'I100' group by 1 union all select source, 'in', count(*) from edges where target = 'I100' group by 1"))
def gra_ego(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(a.edges(spark, d), "I100")


@query(sql(*BASE, NODES, "top_ as (select node from deg order by degree desc, node limit 120)", "select src, dst, weight, num_companies from graph where src in (select node from top_) and dst in (select node from top_)"))
def gra_induced(spark: SparkSession, d: str) -> DataFrame:
    g = written(a.graph(spark, d), "graph")
    return graph.induced(g, graph.top_nodes(g, 120)).select("src", "dst", "weight", "num_companies")


@query(
    sql(*BASE, """both_ as (select src as a, dst as b from graph union select dst, src from graph),
names as (select node, row_number() over (order by node) as i from (select distinct a as node from both_)), e as (select x.i as a, y.i as b from both_ join names x on x.node = a join names y on y.node = b)""",
    "select x.node, y.node as component from (select node, min(root) as root from reach group by 1) r join names x on x.i = r.node join names y on y.i = r.root").replace("with deals", "with recursive deals").replace("\nselect x.node, y.node", ",\nreach as (select i as node, i as root from names union select e.b, reach.root from reach join e on e.a = reach.node)\nselect x.node, y.node")
)
def gra_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(written(a.graph(spark, d), "graph"))


@query()
def gra_approximate_diameter(spark: SparkSession, d: str) -> DataFrame:
    return graph.approximate_diameter(written(deal_ops.undirected(a.graph(spark, d)), "und"))


@query()
def gra_exact_paths(spark: SparkSession, d: str) -> DataFrame:
    return _r(paths.all_pairs(deal_ops.seats(a.deals(spark, d))), "mean_distance")


@query()
def gra_closeness(spark: SparkSession, d: str) -> DataFrame:
    g = written(a.graph(spark, d), "graph")
    return graph.closeness(written(deal_ops.undirected(g), "und"), graph.top_nodes(g, 20))


@query()
def gra_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(written(a.graph(spark, d), "graph"))


@query()
def gra_eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return graph.eigenvector(written(a.graph(spark, d), "graph"))


@query()
def gra_cores(spark: SparkSession, d: str) -> DataFrame:
    return graph.core_numbers(deal_ops.undirected(a.graph(spark, d)))


@query()
def gra_percolation(spark: SparkSession, d: str) -> DataFrame:
    return graph.percolation(written(deal_ops.undirected(a.graph(spark, d)), "und"))


@query()
def gra_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(written(a.graph(spark, d), "graph"))


@query()
def gra_largest_clique(spark: SparkSession, d: str) -> DataFrame:
    return graph.largest_clique(written(deal_ops.undirected(a.graph(spark, d)), "und"))


@query()
def gra_louvain(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    und = written(deal_ops.undirected(g), "und")
    dropped(g)
    return graph.louvain(und)


@query(
    sql(*BASE, UND, """p as (select distinct investor_name as node, country_code as c from deals),
e as (select x.c as ca, y.c as cb, weight as w from und join p x on x.node = a join p y on y.node = b),
d as (select c, sum(w) as d from (select ca as c, w from e union all select cb, w from e) group by 1),
l as (select ca as c, sum(w) as l from e where ca = cb group by 1)
select round(sum(coalesce(l, 0) / (m2 / 2) - (d / m2) ** 2), 6) as modularity from d left join l using (c), (select sum(d) as m2 from d)""")
)
def gra_modularity(spark: SparkSession, d: str) -> DataFrame:
    p = a.deals(spark, d).select(F.col("investor_name").alias("node"), F.col("country_code").alias("community")).distinct()
    return _r(graph.modularity(deal_ops.undirected(a.graph(spark, d)), p), "modularity")


@query(
    sql(*BASE, NODES, """v as (select node, in_degree, out_degree, in_weight from deg),
r as (select node, rank() over (order by in_weight desc) + (count(*) over (partition by in_weight) - 1) / 2.0 as ri, rank() over (order by out_degree desc) + (count(*) over (partition by out_degree) - 1) / 2.0 as ro from v)
select node, floor(ri)::int as rank_in, floor(ro)::int as rank_out, (floor(ri) - floor(ro))::int as divergence from r""")
)
def gra_rank_divergence(spark: SparkSession, d: str) -> DataFrame:
    g = graph.degrees(a.graph(spark, d)).withColumn("in_weight", F.round("in_weight", 9))
    for c, name in (("in_weight", "rank_in"), ("out_degree", "rank_out")):
        g = placed(g, [F.desc(c)], rank=name).withColumn(name, F.floor(F.col(name) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2).cast("int"))
    return g.select("node", "rank_in", "rank_out", (F.col("rank_in") - F.col("rank_out")).alias("divergence"))


ORACLE["gra_rank_divergence"] = ORACLE["gra_rank_divergence"].replace("select node, in_degree, out_degree, in_weight from deg", "select node, in_degree, out_degree, round(in_weight, 9) as in_weight from deg")

TIER = """cut as (select quantile_cont(in_weight, 0.8) as cut, max(in_weight) as most from deg),
tier as (select node, in_weight, in_weight / most as in_rank from deg, cut where in_weight >= cut)"""
STATIC = """pf as (select investor_name as investor, count(distinct company_name) as portfolio_size from deals group by 1),
tps as (select source as investor, sum(weight * in_rank) as tps_raw, count(distinct target) as top_tier_targets, count(distinct company) as companies_hit from edges join tier on node = target group by 1),
scores as (select investor, tps_raw, top_tier_targets, companies_hit, portfolio_size, tps_raw / portfolio_size as tps, out_weight as out_degree from tps join pf using (investor) join deg on node = investor)"""


@query(sql(*BASE, NODES, TIER, "select node, round(in_weight, 4) as in_weight, round(in_rank, 6) as in_rank from tier"))
def tps_top_tier(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(prescience.top_tier(a.graph(spark, d)), "in_weight", digits=4), "in_rank")


@query(sql(*BASE, NODES, TIER, STATIC, "select investor, round(tps_raw, 6) as tps_raw, top_tier_targets, companies_hit, portfolio_size, round(tps, 6) as tps, round(out_degree, 4) as out_degree from scores"))
def tps_static(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals")
    s = prescience.static_scores(written(deal_ops.temporal_edges(deals), "edges"), deals)
    return _r(_r(s, "tps_raw", "tps"), "out_degree", digits=4)


@query(sql(*BASE, NODES, TIER, STATIC, "select investor, round(tps, 6) as tps from scores order by scores.tps desc, investor limit 20"))
def tps_leaders(spark: SparkSession, d: str) -> DataFrame:
    return tps_static(spark, d).select("investor", "tps").orderBy(F.desc("tps"), "investor").limit(20)


EXPANDING = """att as (select eval_date, source, target, sum(weight) as raw, round(sum(weight), 6) as w from edges join quarters on source_date <= eval_date group by 1, 2, 3),
ends as (select eval_date, target as node, w as iw from att union all select eval_date, source, 0 from att),
rk as (select eval_date, node, sum(iw) as iw from ends group by 1, 2),
ct as (select eval_date, quantile_cont(iw, 0.8) as cut, max(iw) as most from rk group by 1),
tr as (select eval_date, node, iw >= cut as in_top_tier, iw / most as in_rank from rk join ct using (eval_date)),
rw as (select att.eval_date, source as investor, sum(raw * in_rank) as tps_raw from att join tr on tr.eval_date = att.eval_date and node = target and in_top_tier group by 1, 2),
pz as (select eval_date, source as investor, count(distinct company) as size from edges join quarters on source_date <= eval_date group by 1, 2),
panel as (select rw.eval_date, rw.investor, tps_raw / size as tps, in_top_tier from rw join pz using (eval_date, investor) join tr on tr.eval_date = rw.eval_date and node = rw.investor)"""


@query(sql(DEALS, a.EDGES, QUARTERS, EXPANDING, "select eval_date, investor, round(tps, 6) as tps, in_top_tier from panel"))
def tps_expanding(spark: SparkSession, d: str) -> DataFrame:
    return _r(prescience.expanding_scores(written(a.edges(spark, d).select("source", "target", "company", "weight", "source_date"), "edges"), a.quarters(spark)), "tps")


@query(sql(DEALS, a.EDGES, f"select case when source_date <= date '{a.CUTOFF}' then 'train' else 'test' end as part, count(*) as n, round(sum(weight), 4) as weight from edges group by 1"))
def tps_temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return _r(prescience.temporal_split(a.edges(spark, d), a.CUTOFF).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), "weight", digits=4)


def _part(name: str, where: str) -> str:
    """The graph, tier and degrees of some edges, under a prefix."""
    return f"""{name}e as (select * from edges where {where}), {name}graph as (select source as src, target as dst, round(sum(weight), 4) as weight from {name}e group by 1, 2),
{name}deg as (select node, sum(iw) as in_weight from (select dst as node, weight as iw from {name}graph union all select src, 0 from {name}graph) group by 1),
{name}tier as (select node, in_weight / (select max(in_weight) from {name}deg) as in_rank from {name}deg where in_weight >= (select quantile_cont(in_weight, 0.8) from {name}deg))"""


@query(
    sql(DEALS, a.EDGES, _part("a", f"source_date <= date '{a.CUTOFF}'"), _part("b", f"source_date > date '{a.CUTOFF}'"), """pf as (select investor_name as investor, count(distinct company_name) as size from deals group by 1),
best as (select source as investor, sum(weight * in_rank) / any_value(size) as tps from ae join atier on node = target join pf on pf.investor = source group by 1 order by 2 desc, 1 limit 50),
hits as (select source, source in (select investor from best) as hit from be semi join btier on node = target), m as (select count(distinct source) filter (where hit) / 50.0::double as p, count(*) filter (where hit) / count(*)::double as r from hits)""",
    "select round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m")
)
def tps_evaluation(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals")
    e = written(prescience.temporal_split(deal_ops.temporal_edges(deals), a.CUTOFF), "edges")
    train, test = e.filter("part = 'train'"), e.filter("part = 'test'")
    return _r(prescience.evaluate(prescience.static_scores(train, deals), test, prescience.top_tier(deal_ops.assemble(test))), "precision", "recall", "f1")


EARLY = f"early as (select * from deals where funded_at <= date '{a.CUTOFF}')"
LINKS = """b as (select distinct company_name, investor_name from early),
only_a as (select distinct company_name from early where funding_round_type = 'series-a' except select company_name from early where funding_round_type = 'series-b'),
dg as (select investor_name as w, count(*) as deg from b group by 1),
mates as (select distinct x.investor_name as w, y.investor_name as investor from b x join b y using (company_name) where x.investor_name <> y.investor_name),
met as (select company_name as company, b.investor_name as w, investor from b join only_a using (company_name) join mates on mates.w = b.investor_name),
fresh as (select met.* from met anti join b on b.company_name = met.company and b.investor_name = met.investor)"""


@query(sql(DEALS, EARLY, LINKS, "select company_name from only_a"))
def lnk_only_first_round(spark: SparkSession, d: str) -> DataFrame:
    return linkpred.only_first_round(a.deals(spark, d).filter(f"funded_at <= date'{a.CUTOFF}'"))


@query(sql(DEALS, EARLY, LINKS, "select company, investor, count(*) as cn, round(coalesce(sum(case when deg > 1 then 1 / ln(deg) end), 0), 4) as aa, round(coalesce(sum(case when deg > 1 then 0.01 / ln(deg) end), 0), 4) as tps_aa from fresh join dg using (w) group by 1, 2"))
def lnk_scores(spark: SparkSession, d: str) -> DataFrame:
    early = written(a.deals(spark, d).filter(f"funded_at <= date'{a.CUTOFF}'"), "early")
    return linkpred.link_scores(early, linkpred.only_first_round(early))


@query(
    sql(DEALS, EARLY, LINKS, f"""s as (select company, investor, round(coalesce(sum(case when deg > 1 then 0.01 / ln(deg) end), 0), 4) as tps_aa from fresh join dg using (w) group by 1, 2),
t as (select distinct company_name as company, investor_name as investor from deals where funded_at > date '{a.CUTOFF}'), r as (select *, row_number() over (order by tps_aa desc, company, investor) as r from s qualify r <= 50)""",
    "select k, count(t.company) / k::double as precision from r left join t using (company, investor), (values (10), (20), (50)) v(k) where r <= k group by 1")
)
def lnk_precision(spark: SparkSession, d: str) -> DataFrame:
    deals = written(a.deals(spark, d), "deals")
    early = deals.filter(f"funded_at <= date'{a.CUTOFF}'")
    s = written(linkpred.link_scores(early, linkpred.only_first_round(early)), "links")
    truth = deals.filter(f"funded_at > date'{a.CUTOFF}'").select(F.col("company_name").alias("company"), F.col("investor_name").alias("investor"))
    return linkpred.precision_at(s, truth)


@query(
    sql(*BASE, UND, """both_ as (select a as w, b as x from und union all select b, a from und), dg as (select w, count(*) as deg from both_ group by 1),
s as (select p.x as a, q.x as b, sum(1 / ln(deg)) as aa from both_ p join both_ q on p.w = q.w and p.x < q.x join dg on dg.w = p.w group by 1, 2)
select a, b, round(aa, 6) as aa from s anti join und using (a, b) order by 3 desc, a, b limit 3""")
)
def lnk_missing(spark: SparkSession, d: str) -> DataFrame:
    return linkpred.missing_links(written(deal_ops.undirected(a.graph(spark, d)), "und"))


@query()
def sim_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = written(a.graph(spark, d), "graph")
    seeds = graph.top_nodes(g, 5).crossJoin(spark.range(3).select(F.col("id").alias("run")))
    return diffusion.cascade(g, seeds, 0.05, 30).groupBy("run", "round").agg(F.count(F.lit(1)).alias("n"))


@query()
def sim_thresholds(spark: SparkSession, d: str) -> DataFrame:
    g = written(a.graph(spark, d), "graph")
    return diffusion.thresholds(g, graph.top_nodes(g, 50).withColumn("run", F.lit(1)), rounds=30).groupBy("run", "round").agg(F.count(F.lit(1)).alias("n"))


@query()
def sim_contagion(spark: SparkSession, d: str) -> DataFrame:
    g = written(a.graph(spark, d), "graph")
    return diffusion.contagion(g, graph.top_nodes(g, 5).withColumn("run", F.lit(1)), 0.1, 0.2, 50)


@query()
def sim_greedy_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    picked = diffusion.greedy_influence(g, graph.top_nodes(g, 50), 5, 0.1, sims=10, rounds=20)
    return spark.createDataFrame(list(enumerate(picked, 1)), "place int, node string")
