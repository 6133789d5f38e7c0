"""Schemas of requests and results on the wire."""

from __future__ import annotations

REQUEST = (
    "job_id string, mode string, "
    "build struct<entities:array<struct<id:string,embeddings:array<array<double>>>>,table:string,entity:string,config:struct<k:int,p:int,k_graph:int,max_chunks:int,distance:string>>, "
    "query struct<graph:string,query:struct<type:string,from:string,to:string,depth:int>>"
)
PATH = "struct<nodes:array<string>,distances:array<double>,total_distance:double>"
TOPOLOGY = (
    "struct<communities:array<struct<members:array<string>,root:string>>,basins:array<struct<attractor:string,members:array<string>>>,"
    "bridges:array<struct<id:string,home_community:bigint,reached_communities:array<bigint>>>,hub_centrality:array<struct<id:string,in_degree:bigint>>,"
    "hub_concentration:double,bidirectional_edges:array<array<string>>>"
)
RESULT = (
    "job_id string, success boolean, error string, "
    f"result struct<graph:string,entities:bigint,chunks:bigint,path:{PATH},reachable:array<struct<id:string,hops:bigint,distance:double>>,topology:{TOPOLOGY}>, "
    "worker_id string, timestamp string"
)
STATUS = "job_id string, status string, worker_id string, timestamp string"
LOG = "job_id string, level string, message string, timestamp string"
CORPUS = "model string, dimension int, entries array<struct<id:string,doc:string,cluster:string,chunk_idx:int,text:string,embedding:array<double>>>"
EMPTY_TOPOLOGY = {"communities": [], "basins": [], "bridges": [], "hub_centrality": [], "hub_concentration": 0.0, "bidirectional_edges": []}
