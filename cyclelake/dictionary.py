"""Label vocabularies of the machine brands and of the ERP exports (fixed values).

Order matters: of several entries that fit a column the last one wins. A site adds its own
labels by passing more rows of the same shape, or by versioned aliases (see `mapping`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DICTIONARY_SCHEMA = (
    "ordinal int, canonical string, unit string, brand string, label string, source_unit string, scale double"
)

# --- fixed values: canonical metric, unit, then per brand the source labels -------------
LABELS = [
    ("cycle_time_s", "s", [
        ("arburg", ["t4012", "T4012", "Temps de cycle, valeur réelle", "tc"]),
        ("engel", ["t_cycle", "CycleTime", "cycle_t"]),
        ("haitian", ["CycleTime", "tCycle", "Cycle_T"]),
        ("kraussmaffei", ["CycleTime", "t_zyklus"]),
        ("sumitomo", ["CycleTime", "tc_s"]),
        ("fanuc", ["CycleTime", "CYCLE_TIME"]),
        ("generic", ["cycle_time_s", "cycle_time", "CycleTime", "t_cycle", "tc", "temps_cycle", "cycle", "Cycle_Time"]),
        ("generic", ["Cycle_Time_ms"], "ms", 0.001),
    ]),
    ("dosing_time_s", "s", [
        ("arburg", ["t4015", "T4015", "Temps de dosage, valeur réelle", "t_dos"]),
        ("engel", ["t_dos", "ActivePlastificationTime", "PlastTime"]),
        ("haitian", ["DosingTime", "t_plast", "DosingT"]),
        ("kraussmaffei", ["PlastificationTime", "t_dosage", "t_plast"]),
        ("sumitomo", ["ChargingTime", "t_charge"]),
        ("fanuc", ["DOSING_TIME", "DosingTime"]),
        ("generic", ["dosing_time_s", "dosing_time", "DosingTime", "t_dos", "t_dosage", "plastification"]),
    ]),
    ("injection_time_s", "s", [
        ("arburg", ["t4018", "T4018", "Temps d'injection, valeur réelle"]),
        ("engel", ["t_inj", "InjectionTime", "Inj_t"]),
        ("haitian", ["InjectionTime", "t_injection"]),
        ("kraussmaffei", ["InjectionTime", "t_einspritzen"]),
        ("sumitomo", ["InjectionTime", "t_inj"]),
        ("generic", ["injection_time_s", "injection_time", "InjectionTime", "t_injection", "t_inj"]),
    ]),
    ("cushion_mm", "mm_or_cm3", [
        ("arburg", ["V4062", "v4062", "Matelas de matière, valeur réelle", "matelas"]),
        ("engel", ["v_mat", "Cushion", "cushion_vol"]),
        ("haitian", ["CushionVolume", "Cushion", "v_cushion"]),
        ("kraussmaffei", ["Staukissen", "cushion", "v_staukissen"]),
        ("sumitomo", ["CushionPosition", "cushion_pos"]),
        ("generic", ["cushion_mm", "cushion", "matelas", "CushionVolume", "v_mat"]),
    ]),
    ("switchover_pressure_bar", "bar", [
        ("arburg", ["p4072", "P4072", "Pression de commutation, valeur réelle"]),
        ("engel", ["p_sw", "SwitchoverPressure", "p_umschalt"]),
        ("haitian", ["SwitchoverPressure", "p_switch"]),
        ("kraussmaffei", ["UmschaltDruck", "switchover_pressure"]),
        ("generic", ["switchover_pressure_bar", "switchover_pressure", "SwitchoverPressure", "p4072", "p_switch", "pression_commut"]),
    ]),
    ("switchover_position", "mm_or_cm3", [
        ("arburg", ["V4065", "v4065", "Volume de commutation, valeur réelle"]),
        ("engel", ["v_sw", "SwitchoverPosition", "pos_sw"]),
        ("haitian", ["SwitchoverPos", "v_switch"]),
        ("generic", ["switchover_position_mm", "switchover_position", "SwitchoverPosition", "SwitchoverPos", "V4065", "v_switch", "v_commut"]),
    ]),
    ("good_parts", "count", [
        ("arburg", ["f077", "F077", "Pièces bonnes"]),
        ("engel", ["n_good", "GoodParts", "good_pc"]),
        ("haitian", ["GoodParts", "pieces_bonnes"]),
        ("generic", ["good_part", "good_parts", "GoodParts", "f077", "pieces_bonnes"]),
    ]),
    ("cycle_counter", "count", [
        ("arburg", ["f1403", "F1403", "Compteur cycles protocolés"]),
        ("engel", ["n_cycle", "CycleCounter", "cycle_count"]),
        ("haitian", ["CycleCount", "cycle_no"]),
        ("generic", ["cycle_counter", "CycleCounter", "f1403", "num_cycle"]),
    ]),
    ("oil_temperature_c", "celsius", [
        ("arburg", ["t5001", "T_huile", "OilTemp"]),
        ("engel", ["T_oil", "OilTemperature"]),
        ("haitian", ["OilTemp", "t_huile"]),
        ("generic", ["oil_temperature_c", "oil_temperature", "OilTemp", "T_oil", "t_huile"]),
    ]),
    ("peak_pressure_bar", "bar", [
        ("arburg", ["p4073", "Pression de pointe"]),
        ("engel", ["p_max", "PeakPressure"]),
        ("generic", ["peak_pressure_bar", "peak_pressure", "PeakPressure", "Inj_Pres"]),
        ("generic", ["Inj_Pres_psi"], "psi", 0.0689475729),
    ]),
    ("clamp_force_kn", "kn", [
        ("engel", ["f_clamp", "ClampForce"]),
        ("generic", ["clamp_force_kn", "clamp_force"]),
    ]),
    ("scrap_flag", "boolean", [("generic", ["scrap_flag"])]),
    ("barrel_temp_zone1_c", "celsius", [("generic", ["barrel_temp_zone1_c", "barrel_temp_zone1"])]),
    ("barrel_temp_zone2_c", "celsius", [("generic", ["barrel_temp_zone2_c", "barrel_temp_zone2"])]),
    ("barrel_temp_zone3_c", "celsius", [("generic", ["barrel_temp_zone3_c", "barrel_temp_zone3"])]),
    ("cooling_time_s", "s", [("generic", ["cooling_time_s", "cooling_time", "CoolingTime", "t_cooling"])]),
    ("mold_temperature_c", "celsius", [("generic", ["mold_temperature_c", "mold_temperature", "MoldTemperature"])]),
    ("energy_kwh", "kwh", [("generic", ["energy_kwh", "energy", "EnergyKWh"])]),
    ("mold_open_time_s", "s", [("generic", ["mold_open_time_s", "mold_open_time", "MoldOpenTime"])]),
]

# ERP columns: canonical field and its source labels; a later label wins where it has a value.
ERP_LABELS = {
    "id": ["Réf OF", "production_order_id"],
    "machine_erp_ref": ["Réf. Machine", "machine_erp_ref"],
    "machine_name": ["Lib. Machine", "machine_name"],
    "started_at": ["Début Equipe", "started_at"],
    "ended_at": ["Fin Equipe", "ended_at"],
    "shift_number": ["Num Equipe", "shift_number"],
    "product_ref": ["Réf. produit", "product_ref"],
    "product_name": ["Lib. Produit", "product_name"],
    "tool_ref": ["Réf. outil", "tool_ref"],
    "material_ref": ["Réf. Matière", "material_ref"],
    "erp_good_parts": ["Qté Pieces Bonnes", "good_parts"],
    "erp_scrap_count": ["Total Rebuts", "scrap_count"],
    "erp_trs": ["T.R.S.", "expected_trs"],
    "erp_available_time_h": ["Tps Disponible (h)", "planned_runtime_h"],
    "erp_running_time_h": ["Tps Fct Brut (h)"],
    "erp_cycle_time_s": ["Cycle Moyen", "theoretical_cycle_time_s"],
    "nb_cycles": ["Nb Cycles"],
}
# --------------------------------------------------------------------------------------


def label_dictionary(spark: SparkSession) -> DataFrame:
    """The brand vocabulary as rows; its size is fixed, so joins broadcast it."""
    rows = []
    for canonical, unit, brands in LABELS:
        for brand, labels, *conversion in brands:
            source_unit, scale = conversion if conversion else (unit, 1.0)
            for label in labels:
                rows.append((len(rows), canonical, unit, brand, label, source_unit, float(scale)))
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)
