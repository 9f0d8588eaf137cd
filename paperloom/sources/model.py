"""Schemas of documents and elements, in tables and in exported JSON."""

from __future__ import annotations

LOCATION = "struct<`order`:int,sheet:string,anchor:string,slide:int,shape_name:string,page:int,bbox:array<double>,from_image:string,bbox_in_image:array<double>>"
METADATA = "struct<title:string,author:string,created:string,modified:string>"
ELEMENT = f"struct<elem_ord:int,type:string,content:string,style:string,n_rows:int,n_cols:int,rows:array<array<string>>,file:string,format:string,width:int,height:int,ocr_text:string,location:{LOCATION}>"
#: What a parser gives for one file; image bytes are apart, so that no shuffle of elements carries them.
PARSED = f"metadata {METADATA}, elements array<{ELEMENT}>, images array<struct<file:string,bytes:binary>>, error string"
#: A document as exported, one JSON object.
RESULT = f"id string, source string, source_abspath string, source_hash string, content_hash string, file_type string, metadata {METADATA}, summary map<string,bigint>, elements array<{ELEMENT.replace('elem_ord:int,', '')}>"
