"""What the plans look like, not only what they give."""

from graphloom.queries import cypher
from graphloom.sources.tables import table_graph

SF = "/root/testdata/sf0.001"


def plan(spark, text):
    df = cypher(table_graph(spark, SF), text)
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_nodes_held_by_edges_are_not_joined(spark):
    logical, physical = plan(spark, "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000.0 RETURN c.c_name, o.o_orderkey")
    assert logical.count("Join ") == 1 and "CartesianProduct" not in physical and "NestedLoop" not in physical
    pushed = physical.partition("PushedFilters: [")[2]
    assert "GreaterThan(o_totalprice,1" in pushed
    assert "o_orderpriority" not in physical and "c_acctbal" not in physical


def test_identities_alone_need_no_node_tables(spark):
    logical, _ = plan(spark, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(*)")
    assert "Join " not in logical
    logical, _ = plan(spark, "MATCH (c:Customer)-[:PLACED]->(o)-[:CONTAINS]->(p:Part) RETURN count(*)")
    assert logical.count("Join ") == 1


def test_tables_that_cannot_match_are_not_read(spark):
    logical, _ = plan(spark, "MATCH (n:Nation)-[:IN_REGION]->(r {r_name: 'ASIA'}) RETURN n.n_name")
    assert logical.count("Relation") == 2
    logical, _ = plan(spark, "MATCH (c)-[e]->(n:Nation) RETURN type(e), count(*)")
    assert logical.count("Relation") == 2  # customers and suppliers


def test_semi_joins(spark):
    logical, _ = plan(spark, "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) RETURN c.c_name")
    assert "LeftSemi" in logical
    logical, _ = plan(spark, "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.c_name")
    assert "LeftAnti" in logical


def test_top_k_is_one_step(spark):
    _, physical = plan(spark, "MATCH (o:Order) RETURN o.o_orderkey AS o ORDER BY o.o_totalprice DESC LIMIT 10")
    assert "TakeOrderedAndProject" in physical
