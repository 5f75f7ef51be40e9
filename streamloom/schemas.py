"""Schemas of the relations that operators take and give."""

from __future__ import annotations

DATAGRAMS = "arrival_id bigint, arrival_ts timestamp, data binary"
RTP_PACKETS = "stream_id bigint, arrival_id bigint, seq int, rtp_ts bigint, ssrc bigint, marker boolean, pt int, payload binary"
ORDERED_PACKETS = "stream_id bigint, seq_ext bigint, marker boolean, gap boolean, payload binary"
PAYLOAD_HEADER = "struct<mh:int,ordb:boolean,pos:int,pid:int>"
RECTANGLE = "struct<x0:int,y0:int,x1:int,y1:int>"

SIZ = "struct<rsiz:int,xsiz:bigint,ysiz:bigint,xosiz:bigint,yosiz:bigint,xtsiz:bigint,ytsiz:bigint,xtosiz:bigint,ytosiz:bigint,csiz:int,comps:array<struct<ssiz:int,xr:int,yr:int>>>"
CODING = "max_precinct:boolean,use_sop:boolean,use_eph:boolean,use_h_offset:boolean,use_v_offset:boolean,use_blkcoder_extension:boolean,nl:int,cbw:int,cbh:int,cbs:int,transform:int,prec:array<struct<prw:int,prh:int>>"
COD = f"struct<{CODING},progression_order:int,num_layers:int,mct:int>"
COC = f"array<struct<c:int,{CODING},step_x:int,step_y:int>>"
QCD = "struct<type:int,num_guard_bits:int,steps:array<struct<exponent:int,mantissa:int>>>"
DFS = "struct<idx:int,idfs:int,levels:array<struct<level:int,type:int,h_orient:int,v_orient:int,hor_depth:int,ver_depth:int>>>"
MAIN_HEADER = f"struct<valid:boolean,sod_off:int,geom_sig:string,ccap2:int,ccap15:int,siz:{SIZ},cod:{COD},cocs:{COC},qcd:{QCD},dfs:{DFS},warnings:array<string>>"

FRAME_EVENTS = "stream_id bigint, event_no bigint, frame_id bigint, kind string, offset bigint, len int, reason int, intact boolean, pid bigint, trunc int, total int"
CODEBLOCK_SEGMENTS = "stream_id bigint, frame_id bigint, crp_idx int, c int, r int, p int, b int, cb int, incl boolean, zbp int, npasses int, lblock int, len0 int, len1 int, length int, scup int, byte_offset bigint"
PRECINCT_LOG = "stream_id bigint, frame_id bigint, step bigint, crp_idx int, c int, r int, p int, status string, byte_offset bigint, n_bytes bigint, skipped int, reason string, overrun boolean"
