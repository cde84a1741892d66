"""What coded tables and labels mean: fixed values that results depend on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.columns import fold

# The features of coded tables, each with the codes by dimension that make it up.
FEATURE_RULES = {
    "rail_pa_total": [("rail_passenger_km", {"unit": "MIO_PKM"}), ("rail_passengers", {"unit": "THS_PAS"})],
    "rail_go_total": [("rail_freight_tonne_km", {"unit": "MIO_TKM"}), ("rail_freight_tonnes", {"unit": "THS_T"})],
    "rail_pa_typepas": [("rail_passenger_km", {"tra_cov": "TOTAL", "unit": "MIO_PKM"}), ("rail_passengers", {"tra_cov": "TOTAL", "unit": "THS_PAS"})],
    "rail_pa_nbpass": [("rail_passengers", {"tra_cov": "TOTAL", "unit": "PAS"})],
    "rail_if_line_tr": [("rail_network_length_km", {"tra_infr": "TOTAL", "n_tracks": "TOTAL", "unit": "KM"})],
    "rail_if_tracks": [("rail_track_length_km", {"tra_infr": "TOTAL", "unit": "KM"})],
    "rail_if_electri": [("rail_electrified_km", {"power": "TOTAL", "unit": "KM"})],
    "rail_ec_emplo_a": [("rail_employees", {"rail_act": "TOTAL", "unit": "NR"})],
    "rail_ec_expend": [("rail_investment", {"expend": {"INF_INV", "RSTK_INV"}, "unit": "MIO_EUR"})],
    "rail_eq_locon": [("rail_locomotives", {"vehicle": "LOC", "mot_nrg": "TOTAL", "unit": "NR"})],
    "rail_eq_wagon": [("rail_wagons", {"vehicle": "WAG", "unit": "NR"})],
    "rail_ac_catnmbr": [("rail_accidents", {"accident": "TOTAL", "unit": "NR"})],
    "rail_ac_catvict": [("rail_fatalities", {"accident": "TOTAL", "victim": "KIL", "pers_cat": "TOTAL", "unit": "NR"})],
    "tran_sf_railac": [("rail_accidents", {"accident": "TOTAL", "unit": "NR"})],
    "tran_sf_railvi": [("rail_fatalities", {"accident": "TOTAL", "victim": "KIL", "pers_cat": "TOTAL", "unit": "NR"})],
    "rail_tf_trainmv": [("rail_train_km", {"train": "TOTAL", "unit": "THS_TRKM"})],
    "rail_tf_vehimov": [("rail_vehicle_km", {"vehicle": "TOTAL", "mot_nrg": "TOTAL", "unit": "THS_VKM"})],
    "rail_tf_haulmov": [("rail_gross_tonne_km", {"train": "TOTAL", "vehicle": "TOTAL", "mot_nrg": "TOTAL", "unit": "MIO_GTKM"})],
    "rail_tf_hauseat": [("rail_seat_km", {"vehicle": "TOTAL", "unit": "MIO_SKM"})],
    "tran_r_net": [("rail_network_length_km", {"tra_infr": "RL", "unit": "KM"}), ("rail_electrified_km", {"tra_infr": "RL_ELC", "unit": "KM"})],
    "tran_hv_frmod": [("freight_modal_split_rail_pct", {"tra_mode": "RAIL", "unit": "PC"})],
    "tran_hv_psmod": [("passenger_modal_split_rail_pct", {"vehicle": "TRN", "unit": "PC"})],
    "nama_10_gdp": [("gdp_current_meur", {"na_item": "B1GQ", "unit": "CP_MEUR"}), ("gdp_growth_pct", {"na_item": "B1GQ", "unit": "CLV_PCH_PRE"}), ("gdp_pps", {"na_item": "B1GQ", "unit": "CP_MPPS_EU27_2020"})],
    "nama_10_pc": [("gdp_per_capita_eur", {"na_item": "B1GQ", "unit": "CP_EUR_HAB"}), ("gdp_per_capita_pps", {"na_item": "B1GQ", "unit": "CP_PPS_EU27_2020_HAB"})],
    "nama_10_a10": [("gva_total_meur", {"nace_r2": "TOTAL", "na_item": "B1G", "unit": "CP_MEUR"}), ("compensation_employees_meur", {"nace_r2": "TOTAL", "na_item": "D1", "unit": "CP_MEUR"})],
    "gov_10dd_edpt1": [("gov_debt_pct_gdp", {"sector": "S13", "na_item": "GD", "unit": "PC_GDP"}), ("gov_deficit_pct_gdp", {"sector": "S13", "na_item": "B9", "unit": "PC_GDP"})],
    "gov_10a_main": [("gov_revenue_pct_gdp", {"sector": "S13", "na_item": "TR", "unit": "PC_GDP"}), ("gov_expenditure_pct_gdp", {"sector": "S13", "na_item": "TE", "unit": "PC_GDP"})],
    "prc_hicp_aind": [("inflation_pct", {"coicop": "CP00", "unit": "RCH_A_AVG"})],
    "une_rt_a": [("unemployment_rate_pct", {"age": "Y15-74", "sex": "T", "unit": "PC_ACT"})],
    "earn_nt_net": [("net_earnings_eur", {"currency": "EUR", "estruct": "NET", "ecase": "P1_NCH_AW100"})],
    "demo_pjan": [("population_total", {"age": "TOTAL", "sex": "T", "unit": "NR"})],
    "demo_gind": [("pop_growth_rate", {"indic_de": "GROWRT"}), ("birth_rate", {"indic_de": "GBIRTHRT"}), ("death_rate", {"indic_de": "GDEATHRT"}), ("net_migration_rate", {"indic_de": "CNMIGRATRT"})],
    "ilc_pw01": [("life_satisfaction", {"isced11": "TOTAL", "sex": "T", "age": "Y_GE16"})],
    "ilc_pw05": [("life_satisfaction_high_pct", {"lev_satis": "HIGH", "isced11": "TOTAL", "sex": "T", "age": "Y_GE16"})],
    "ilc_di12": [("gini_coefficient", {"age": "TOTAL"})],
    "ilc_li02": [("poverty_risk_rate_pct", {"rskpovth": "A_60", "unit": "PC", "sex": "T", "age": "TOTAL", "statinfo": "MED_EI"})],
    "ilc_peps01": [("arope_rate_pct", {"unit": "PC", "age": "TOTAL", "sex": "T"})],
    "ilc_mddd11": [("material_deprivation_pct", {"unit": "PC", "age": "TOTAL", "sex": "T"})],
    "road_eqs_carhab": [("cars_per_1000_inhabitants", {"unit": "NR"})],
    "prc_ppp_ind": [("price_level_index", {"na_item": "PLI_EU27_2020", "ppp_cat": "GDP"}), ("ppp_factor", {"na_item": "PPP_EU27_2020", "ppp_cat": "GDP"})],
    "rail_pa_speed": [("rail_high_speed_pkm", {"vehicle": "TRN_HSPD", "unit": "MIO_PKM"})],
}
# The features of indicators by code.
INDICATORS = {
    "IS.RRS.TOTL.KM": "rail_network_length_km",
    "IS.RRS.GOOD.MT.K6": "rail_freight_tonne_km",
    "IS.RRS.PASG.KM": "rail_passenger_km",
    "IS.VEH.PCAR.P3": "cars_per_1000",
    "NY.GDP.MKTP.CD": "gdp_current_usd",
    "NY.GDP.PCAP.CD": "gdp_per_capita_usd",
    "NY.GNP.PCAP.CD": "gni_per_capita_usd",
    "NY.GDP.MKTP.KD.ZG": "gdp_growth_pct",
    "PA.NUS.PPP": "ppp_conversion_factor",
    "FP.CPI.TOTL.ZG": "inflation_pct",
    "SL.UEM.TOTL.ZS": "unemployment_rate_pct",
    "GC.DOD.TOTL.GD.ZS": "gov_debt_pct_gdp",
    "NE.EXP.GNFS.ZS": "exports_pct_gdp",
    "NE.IMP.GNFS.ZS": "imports_pct_gdp",
    "BX.KLT.DINV.WD.GD.ZS": "fdi_pct_gdp",
    "SP.POP.TOTL": "population_total",
    "SP.POP.GROW": "pop_growth_rate",
    "SP.URB.TOTL.IN.ZS": "urban_population_pct",
    "EN.POP.DNST": "population_density",
    "SP.DYN.LE00.IN": "life_expectancy_years",
    "SP.DYN.TFRT.IN": "fertility_rate",
    "SP.DYN.IMRT.IN": "infant_mortality_rate",
    "SE.XPD.TOTL.GD.ZS": "education_spend_pct_gdp",
    "SH.XPD.CHEX.GD.ZS": "health_spend_pct_gdp",
    "EG.ELC.ACCS.ZS": "electricity_access_pct",
    "SI.POV.GINI": "gini_coefficient",
    "IT.NET.USER.ZS": "internet_users_pct",
    "SH.STA.SUIC.P5": "suicide_rate",
    "VC.IHR.PSRC.P5": "homicide_rate",
    "EN.GHG.CO2.PC.CE.AR5": "co2_per_capita",
    "EN.ATM.CO2E.PC": "co2_per_capita",
}
# What a label means that has these words; the first that fits counts.
LABEL_RULES = [
    ("length of lines worked at end of year - electrified lines", "rail_electrified_km"),
    ("length of lines worked at end of year - total", "rail_network_length_km"),
    ("of which electrified lines", "rail_electrified_km"),
    ("passenger.kilometres", "rail_passenger_km"),
    ("tonne.kilometres", "rail_freight_tonne_km"),
    ("tonnes carried", "rail_freight_tonnes"),
    ("average staff strength", "rail_employees"),
    ("locomotives including", "rail_locomotives"),
    ("railway's wagons", "rail_wagons"),
    ("electrified railway", "rail_electrified_km"),
    ("electrified rail", "rail_electrified_km"),
    ("length of lines", "rail_network_length_km"),
    ("rail lines", "rail_network_length_km"),
    ("railway lines", "rail_network_length_km"),
    ("railway operated", "rail_network_length_km"),
    ("standard gauge railways", "rail_network_length_km"),
    ("route-km", "rail_network_length_km"),
    ("network", "rail_network_length_km"),
    ("passenger carriages", "rail_rolling_stock"),
    ("freight wagons", "rail_rolling_stock"),
    ("locomotive", "rail_rolling_stock"),
    ("wagon", "rail_rolling_stock"),
    ("tonne-kilometres", "rail_freight_tonne_km"),
    ("ton-kilometres", "rail_freight_tonne_km"),
    ("tonne-km", "rail_freight_tonne_km"),
    ("ton-km", "rail_freight_tonne_km"),
    ("freight", "rail_freight_tonnes"),
    ("goods", "rail_freight_tonnes"),
    ("passenger kilometres", "rail_passenger_km"),
    ("passenger-km", "rail_passenger_km"),
    ("passengers carried", "rail_passengers"),
    ("number of passengers", "rail_passengers"),
    ("passenger", "rail_passengers"),
    ("accident", "rail_accidents"),
    ("victim", "rail_fatalities"),
    ("killed", "rail_fatalities"),
    ("investment", "rail_investment"),
    ("rolling stock", "rail_rolling_stock"),
    ("employ", "rail_employees"),
]
# German labels; a total of these stocks, or any with these words.
GERMAN_RULES = [("transportleistung", "rail_freight_tonne_km"), (" tkm", "rail_freight_tonne_km"), ("transportaufkommen", "rail_freight_tonnes")]
GERMAN_TOTALS = [("lokomotivbestand", "rail_locomotives"), ("schienenguterwagenbestand", "rail_wagons"), ("schienentriebfahrzeugbestand", "rail_rolling_stock"), ("schienenpersonenwagenbestand", "rail_rolling_stock")]
FEATURES = sorted({f for rules in FEATURE_RULES.values() for f, _ in rules} | set(INDICATORS.values()) | {f for _, f in [*LABEL_RULES, *GERMAN_RULES, *GERMAN_TOTALS]})


def label_feature(label: Column) -> Column:
    """The feature that a label names, null where no rule knows it; a feature's own name stands for itself.

    Of a label with parts the last one decides if it can; labels are compared in lower case, with and without accents. A road network is none.
    """
    whole = F.concat_ws(" ", F.lower(label), fold(label))
    last = F.element_at(F.split(whole, " - "), -1)

    def by_rules(text: Column) -> Column:
        first = lambda rules, other: reduce(lambda out, r: F.when(text.contains(r[0]), r[1]).otherwise(out), reversed(rules), other)
        english = first(LABEL_RULES, F.lit(None).cast("string"))
        totals = F.when(text.contains("insgesamt"), first(GERMAN_TOTALS, english)).otherwise(english)
        return first(GERMAN_RULES, totals)

    road = lambda text: text.contains("road network") & ~text.contains("rail")
    decided = F.when(road(last), None).otherwise(F.coalesce(by_rules(last), F.when(~road(whole), by_rules(whole))))
    return F.when(label.isin(FEATURES), label).otherwise(decided)


def label_crosswalk(facts, known=None):
    """(source_column, feature) of each label of facts: from `known` (a reviewed table of the same columns) first, then by rules, else 'unmapped'."""
    labels = facts.select("source_column").distinct()
    ruled = F.coalesce(label_feature(F.col("source_column")), F.lit("unmapped"))
    if known is None:
        return labels.withColumn("feature", ruled)
    kept = known.groupBy("source_column").agg(F.min("feature").alias("known"))
    return labels.join(kept, "source_column", "left").select("source_column", F.coalesce("known", ruled).alias("feature"))
