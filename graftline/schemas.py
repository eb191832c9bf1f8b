"""Record schemas: every scalar may be null ("not recorded")."""
from __future__ import annotations

VARIETY = """id string, name string, aka array<string>, uses array<string>,
 origin struct<country:string, place:string, year:int, year_note:string, kind:string, parentage:string, raised_by:string>, history string,
 look struct<size:string, shape:string, ground:string, blush:string, blush_cover:int, stripes:boolean, russet:int, flesh_colour:string, description:string>,
 taste struct<summary:string, sweet:int, acid:int, aroma:int, tannin:int, crisp:int, juicy:int, tags:array<string>, cider_class:string, best_eaten:string>,
 tree struct<vigor:int, habit:string, bearing:string, cropping:string, biennial:string, precocity:int, ploidy:string, notes:string>,
 pollination struct<flower_group:int, self_fertile:string, notes:string>, season struct<harvest:string, eating:string, storage_weeks:int>,
 climate struct<chill_hours:int, hardiness_zone:int, heat_tolerance:int, colour_needs_cool_nights:boolean, best_climates:string, poor_climates:string>,
 health struct<scab:int, canker:int, mildew:int, fire_blight:int, rust:int, bitter_pit:int, other:string>, grow_notes string, conf string, tags array<string>"""
ROOTSTOCK = """id string, name string, aka array<string>, clones array<string>, series string, origin struct<country:string, place:string, year:int, parentage:string, note:string>,
 size_class string, size_pct_standard array<double>, height_m array<double>, spacing_m array<double>, vigor int, precocity int, first_crop_years array<double>, yield_efficiency int, fruit_size_effect int,
 anchorage int, support string, suckering int, burr_knots int, susceptibility struct<fire_blight:int, collar_rot:int, woolly_aphid:int, crown_gall:int, powdery_mildew:int>,
 tolerance struct<cold:int, drought:int, wet_soil:int, poor_soil:int, heavy_soil:int, replant:int>, hardiness_zone int, uk_availability string, soil_notes string, best_for string, avoid_when string,
 variety_fit string, notes string, conf string"""
REGION_NOTE = "id string, summary string, apple_culture string, local_varieties array<string>, pests_diseases string, tips string, confidence string"
WEB_EVIDENCE = """sources array<struct<src:string, url:string, words:array<string>, tags:array<string>, sweet:int, acid:int, against:array<string>>>, storage_change string,
 climate_flavour struct<needs:string, note:string>, peak string, notes string"""
BOOK_ENTRY = """line int, `end` int, heading string, match string, flavour string, flavour_en string, quality string, storage string, climate string, tags array<string>, against array<string>, sweet int, acid int, note string"""
LAB_RECORD = "accession string, ssc double, ta double, firmness double, firmness_units string, n int, years string, match string, stage string"
ISSUE = "number bigint, title string, body string, created_at timestamp, labels array<struct<name:string>>, pull_request struct<url:string>"
