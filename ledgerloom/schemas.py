"""Schemas of the records that the engine passes on, as DDL."""

SOURCE = "struct<provider:string,source_url:string,external_id:string,data:map<string,string>>"
LEAD = (
    "obs_id bigint, name string, phone string, whatsapp string, whatsapp_confirmed boolean, whatsapp_evidence string, address string, city string, "
    "state string, category string, website string, instagram string, cnpj string, provider string, source_url string, external_id string, data map<string,string>"
)
OVERTURE_PLACE = (
    "id string, names struct<primary:string>, basic_category string, taxonomy struct<primary:string,hierarchy:array<string>,alternates:array<string>>, "
    "categories struct<primary:string,alternate:array<string>>, confidence double, operating_status string, websites array<string>, socials array<string>, phones array<string>, "
    "addresses array<struct<freeform:string,locality:string,region:string,country:string>>, sources array<struct<dataset:string,license:string,update_time:string>>, "
    "bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"
)
OSM_ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
AREA = "west double, south double, east double, north double, city string, state string"
WEB_RESULT = "title string, url string, content string, score double"
EVIDENCE = "company_id bigint, value string, evidence_type string, source_url string, source string, official_source boolean, context string, field_name string"
PAGE_EVIDENCE = "page_id bigint, url string, seq int, field string, value string, evidence_type string, excerpt string"
#: Fields that a resolved company chooses among its observations' values.
FIELDS = ("name", "phone", "whatsapp", "address", "city", "state", "category", "website", "instagram", "cnpj")
