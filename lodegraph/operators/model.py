"""The property graph: node, edge and metric tables, and their vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "id bigint, node_type string, name string, qualified_name string, signature string, return_type string, "
    "parameters array<struct<name:string,param_type:string,default_value:string>>, code_hash string, token_bloom array<bigint>, "
    "file_path string, start_line int, end_line int, properties map<string,string>, labels array<string>"
)
EDGE_SCHEMA = "src bigint, dst bigint, edge_type string, call_type string, access_type string, properties map<string,string>, weight double"

# The vocabulary of node and edge types.
NODE_TYPES = (
    "Function Class Struct Enum Interface Module Variable File ConfigKey TypeAlias Macro Import Table Dependency Job BuildStep "
    "AnsiblePlaybook AnsiblePlay AnsibleTask AnsibleRole AnsibleHandler AnsibleTemplate AnsibleVariable "
    "ChefCookbook ChefRecipe ChefResource ChefTemplate ChefAttribute ChefCustomResource "
    "PuppetManifest PuppetClass PuppetResource PuppetModule PuppetDefine PuppetFact"
).split()
EDGE_TYPES = (
    "Calls Contains Uses Implements Extends References Instantiates Modifies UsesConfig DefinedIn DependsOn IncludesRole DependsOnRole "
    "ExecutesTask NotifiesHandler IncludesPlaybook RendersTemplate DependsOnCookbook IncludesRecipe DeclaresResource UsesTemplate "
    "DefinesAttribute NotifiesResource DependsOnModule IncludesClass InheritsClass RequiresResource UsesFact Unknown"
).split()
STRUCTURAL = ["Contains", "DefinedIn"]
BEHAVIOURAL = ["Calls", "Uses", "References", "Modifies", "Instantiates", "Implements", "Extends", "DependsOn"]
COMMUNITY_EDGES = ["Calls", "Uses"]
NOT_OPERATIONAL = ["Module", "File", "Import", "ConfigKey"]


def completed(df: DataFrame, schema: str) -> DataFrame:
    """All columns of a schema in order; absent ones are null."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds))


def node_table(df: DataFrame) -> DataFrame:
    return completed(df, NODE_SCHEMA)


def edge_table(df: DataFrame) -> DataFrame:
    full = completed(df, EDGE_SCHEMA)
    return full.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def prop(key: str) -> Column:
    """A property as text; missing is null."""
    return F.element_at("properties", key)


def signature_text() -> Column:
    """The signature, or the property of that name in older tables."""
    return F.coalesce("signature", prop("signature"))


def return_type_text() -> Column:
    return F.coalesce("return_type", prop("return_type"))


@dataclass
class Graph:
    """Nodes, edges, and what is known of nodes beyond them."""

    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame | None = None
    communities: DataFrame | None = field(default=None)

    def of(self, types: list[str] | None = None) -> DataFrame:
        """(src, dst) of the edges of some types, parallel edges kept."""
        e = self.edges if types is None else self.edges.filter(F.col("edge_type").isin(types))
        return e.select("src", "dst")

    # A facade: each method is an operator of this package.
    def gql(self, text: str, **known):
        from lodegraph.plans import gql

        return gql.run(self, text, **known)

    def find(self, dsl_text: str) -> DataFrame:
        from lodegraph.plans import dsl

        return dsl.run(self.nodes, dsl_text)

    def pagerank(self, **options) -> DataFrame:
        from lodegraph.operators import ranking

        return ranking.pagerank(self, **options)

    def degree(self, types: list[str] | None = None) -> DataFrame:
        from lodegraph.operators import ranking

        return ranking.degree(self, types)

    def scc(self, types: list[str] | None = None) -> DataFrame:
        from lodegraph.operators import reach

        return reach.strongly_connected(self.nodes.select("id"), self.of(types))

    def blast(self, **options) -> DataFrame:
        from lodegraph.operators import reach

        return reach.blast_scc(self, **options)

    def communities_of(self, **options) -> DataFrame:
        from lodegraph.operators import community

        return community.propagate(self, **options)
