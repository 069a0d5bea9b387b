"""Dataset catalog (S2) and per-domain specifications used by the rule labellers.

Rules are data: an ordered list of ``(mode, SQL predicate)``; a predicate is
compiled with ``F.expr`` so Catalyst sees plain comparisons.  Column names in
predicates are back-quoted because they carry brackets and spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: catalog entries (key, title, file name, domain), in catalog order ---
CATALOG: list[tuple[str, str, str, str]] = [
    ("ai4i2020", "1. UCI AI4I 2020 CNC Milling Machine (10k Rows)", "ai4i2020_predictive_maintenance.csv", "CNC Milling & Machining"),
    ("cmapss", "2. NASA CMAPSS Turbofan Jet Engine (Multi-Sensor RUL)", "nasa_cmapss_turbofan.csv", "Aerospace & Gas Turbines"),
    ("custom_plant", "3. CNC & Robotic Vibro-Acoustic Plant Telemetry", "custom_plant_telemetry.csv", "Robotic Assembly & Spindles"),
    ("ims_bearing", "4. NASA IMS Bearing Run-to-Failure Vibration", "ims_bearing_vibration.csv", "Rotating Machinery Bearings"),
    ("secom_semiconductor", "5. UCI SECOM Semiconductor Wafer Etch Chamber", "secom_semiconductor_wafer.csv", "Semiconductor Fab & Plasma Etch"),
    ("hydraulic_rig", "6. UCI Hydraulic Test Rig Condition Monitoring", "uci_hydraulic_test_rig.csv", "Industrial Hydraulics & Valves"),
    ("centrifugal_pump", "7. Industrial Centrifugal Pump Cavitation & Seal", "industrial_centrifugal_pump.csv", "Chemical & Fluid Processing Pumps"),
    ("wind_turbine_gearbox", "8. Wind & Steam Turbine Gearbox & Generator", "wind_turbine_gearbox_scada.csv", "Power Generation & Turbines"),
    ("steel_rolling_mill", "9. Steel Hot-Rolling Mill Work-Roll & Strip", "steel_hot_rolling_mill.csv", "Heavy Metallurgy & Steel Rolling"),
    ("robotic_spot_welding", "10. Automotive Robotic Spot-Welding & Press Shop", "automotive_robotic_welding.csv", "Automotive Body-in-White Robotics"),
    ("lithium_battery_cell", "11. EV Lithium-Ion Battery Cell Formation & Aging", "ev_lithium_battery_formation.csv", "Gigafactory Battery Manufacturing"),
    ("pharma_bioreactor", "12. Pharmaceutical Bioreactor & Freeze-Dryer", "pharma_bioreactor_lyophilizer.csv", "Bio-Manufacturing & Pharma"),
]

# --- fixed values: domain sensor specs (name, mean, std, min, max) and ordered fault rules ---
DOMAIN_SPECS: dict[str, dict] = {
    "ims_bearing": {
        "sensors": [
            ("Bearing1 RMS [g]", 0.14, 0.05, 0.04, 0.55),
            ("Bearing2 RMS [g]", 0.16, 0.06, 0.05, 0.62),
            ("Vibration Kurtosis", 3.20, 0.95, 1.80, 9.50),
            ("Crest Factor", 4.10, 0.85, 2.20, 8.80),
            ("Envelope Peak [m/s2]", 12.5, 4.2, 3.0, 38.0),
            ("Outer Race Temp [C]", 58.0, 7.5, 38.0, 98.0),
            ("Shaft Speed [rpm]", 2000.0, 45.0, 1820.0, 2180.0),
        ],
        "modes": [
            ("Outer Race Spalling", "`Vibration Kurtosis` > 4.6 AND `Bearing1 RMS [g]` > 0.21"),
            ("Inner Race Defect", "`Envelope Peak [m/s2]` > 18.5 AND `Crest Factor` > 5.2"),
            ("Roller Element Wear", "`Bearing2 RMS [g]` > 0.24 AND `Outer Race Temp [C]` > 68.0"),
        ],
    },
    "secom_semiconductor": {
        "sensors": [
            ("Chamber Pressure [mTorr]", 45.0, 6.2, 24.0, 72.0),
            ("RF Forward Power [W]", 850.0, 65.0, 620.0, 1120.0),
            ("RF Reflected Power [W]", 18.0, 9.5, 1.0, 75.0),
            ("Etch Gas Flow [sccm]", 120.0, 14.0, 72.0, 175.0),
            ("Electrostatic Chuck Temp [C]", 65.0, 4.8, 48.0, 88.0),
            ("Plasma Impedance [Ohm]", 52.0, 5.5, 34.0, 78.0),
            ("DC Bias Voltage [V]", 310.0, 28.0, 210.0, 420.0),
        ],
        "modes": [
            ("Plasma Arcing Fault", "`RF Reflected Power [W]` > 32.0 AND `DC Bias Voltage [V]` > 345.0"),
            ("Chamber Vacuum Drift", "`Chamber Pressure [mTorr]` > 54.0 AND `Etch Gas Flow [sccm]` < 105.0"),
            ("Chuck Thermal Excursion", "`Electrostatic Chuck Temp [C]` > 72.5 AND `RF Forward Power [W]` > 930.0"),
        ],
    },
    "hydraulic_rig": {
        "sensors": [
            ("PS1 Main Pressure [bar]", 162.0, 14.0, 110.0, 215.0),
            ("FS1 Volume Flow [L/min]", 8.4, 1.3, 4.2, 13.5),
            ("TS1 Hydraulic Oil Temp [C]", 48.5, 6.8, 32.0, 76.0),
            ("CP1 Cooler Efficiency [%]", 84.0, 9.5, 42.0, 100.0),
            ("VS1 Valve Switching Lag [ms]", 24.0, 7.2, 8.0, 62.0),
            ("Accumulator Gas Press [bar]", 102.0, 11.0, 64.0, 138.0),
            ("Motor Power [W]", 2450.0, 290.0, 1550.0, 3600.0),
        ],
        "modes": [
            ("Cooler Thermal Breakdown", "`CP1 Cooler Efficiency [%]` < 70.0 AND `TS1 Hydraulic Oil Temp [C]` > 56.0"),
            ("Proportional Valve Lag", "`VS1 Valve Switching Lag [ms]` > 34.5 AND `PS1 Main Pressure [bar]` < 150.0"),
            ("Internal Pump Leakage", "`FS1 Volume Flow [L/min]` < 6.6 AND `Motor Power [W]` > 2750.0"),
        ],
    },
    "centrifugal_pump": {
        "sensors": [
            ("Suction Pressure [kPa]", 115.0, 18.0, 52.0, 180.0),
            ("Discharge Pressure [kPa]", 640.0, 55.0, 440.0, 840.0),
            ("Flow Rate [m3/h]", 145.0, 22.0, 75.0, 225.0),
            ("Impeller Vibration [mm/s]", 3.4, 1.4, 0.6, 10.5),
            ("Motor Phase Current [A]", 42.0, 6.5, 22.0, 68.0),
            ("Mechanical Seal Temp [C]", 64.0, 8.2, 40.0, 98.0),
            ("Pump Speed [rpm]", 2950.0, 65.0, 2720.0, 3150.0),
        ],
        "modes": [
            ("Impeller Cavitation", "`Suction Pressure [kPa]` < 92.0 AND `Impeller Vibration [mm/s]` > 5.0"),
            ("Mechanical Seal Dry-Run", "`Mechanical Seal Temp [C]` > 76.0 AND `Flow Rate [m3/h]` < 120.0"),
            ("Discharge Blockage Overload", "`Discharge Pressure [kPa]` > 720.0 AND `Motor Phase Current [A]` > 50.0"),
        ],
    },
    "wind_turbine_gearbox": {
        "sensors": [
            ("Gearbox Oil Temp [C]", 68.0, 7.8, 42.0, 98.0),
            ("HSS Bearing Vibration [mm/s]", 2.9, 1.2, 0.5, 9.2),
            ("Generator Winding Temp [C]", 82.0, 10.5, 52.0, 125.0),
            ("Rotor Speed [rpm]", 14.5, 2.2, 7.0, 21.5),
            ("Active Power Output [kW]", 1850.0, 320.0, 650.0, 2850.0),
            ("Main Shaft Torque [kNm]", 1180.0, 195.0, 520.0, 1850.0),
            ("Blade Pitch Angle [deg]", 4.5, 2.8, 0.0, 18.0),
        ],
        "modes": [
            ("Planetary Gearbox Overheat", "`Gearbox Oil Temp [C]` > 79.0 AND `HSS Bearing Vibration [mm/s]` > 4.2"),
            ("Stator Insulation Thermal Fault", "`Generator Winding Temp [C]` > 96.0 AND `Active Power Output [kW]` > 2200.0"),
            ("High-Torque Shaft Fatigue", "`Main Shaft Torque [kNm]` > 1440.0 AND `Rotor Speed [rpm]` < 13.0"),
        ],
    },
    "steel_rolling_mill": {
        "sensors": [
            ("Roll Separating Force [kN]", 14200.0, 1650.0, 9200.0, 19800.0),
            ("Strip Interstand Tension [MPa]", 185.0, 26.0, 95.0, 280.0),
            ("Work-Roll Surface Temp [C]", 485.0, 42.0, 350.0, 640.0),
            ("Descaling Water Press [bar]", 175.0, 19.0, 110.0, 235.0),
            ("Stand Chatter Vibration [g]", 0.42, 0.18, 0.05, 1.35),
            ("Strip Gauge Error [um]", 14.0, 8.5, 1.0, 55.0),
            ("Rolling Speed [m/min]", 420.0, 55.0, 240.0, 610.0),
        ],
        "modes": [
            ("Work-Roll Thermal Spalling", "`Work-Roll Surface Temp [C]` > 540.0 AND `Roll Separating Force [kN]` > 16200.0"),
            ("Third-Octave Stand Chatter", "`Stand Chatter Vibration [g]` > 0.68 AND `Rolling Speed [m/min]` > 475.0"),
            ("Strip Cobble & Tension Tear", "`Strip Interstand Tension [MPa]` > 222.0 AND `Strip Gauge Error [um]` > 24.0"),
        ],
    },
    "robotic_spot_welding": {
        "sensors": [
            ("Weld Current [kA]", 9.8, 1.1, 6.2, 14.2),
            ("Electrode Squeeze Force [N]", 3400.0, 380.0, 2100.0, 4800.0),
            ("Dynamic Resistance [uOhm]", 215.0, 32.0, 115.0, 340.0),
            ("Cooling Water Flow [L/min]", 4.8, 0.75, 2.1, 7.4),
            ("Electrode Cap Wear [cycles]", 420.0, 240.0, 1.0, 1100.0),
            ("Weld Time [ms]", 210.0, 24.0, 135.0, 310.0),
        ],
        "modes": [
            ("Weld Expulsion & Splash", "`Weld Current [kA]` > 11.2 AND `Electrode Squeeze Force [N]` < 3100.0"),
            ("Electrode Cap Mushrooming", "`Electrode Cap Wear [cycles]` > 720.0 AND `Dynamic Resistance [uOhm]` > 250.0"),
            ("Torch Cooling Restriction", "`Cooling Water Flow [L/min]` < 3.7 AND `Weld Time [ms]` > 235.0"),
        ],
    },
    "lithium_battery_cell": {
        "sensors": [
            ("Formation Voltage [V]", 3.82, 0.18, 3.15, 4.38),
            ("DC Internal Resistance [mOhm]", 1.85, 0.42, 0.85, 3.80),
            ("Cell Surface Temp [C]", 34.5, 4.8, 22.0, 56.0),
            ("Formation Current [A]", 48.0, 7.5, 24.0, 78.0),
            ("Gas Generation Pressure [kPa]", 18.5, 6.2, 4.0, 48.0),
            ("Capacity Retention [%]", 94.5, 4.2, 76.0, 100.0),
        ],
        "modes": [
            ("SEI Layer High Impedance", "`DC Internal Resistance [mOhm]` > 2.45 AND `Capacity Retention [%]` < 90.0"),
            ("Thermal Exotherm Warning", "`Cell Surface Temp [C]` > 41.5 AND `Formation Current [A]` > 56.0"),
            ("Electrolyte Outgassing Swell", "`Gas Generation Pressure [kPa]` > 27.5 AND `Formation Voltage [V]` > 4.05"),
        ],
    },
    "pharma_bioreactor": {
        "sensors": [
            ("Chamber Vacuum [mTorr]", 110.0, 24.0, 45.0, 220.0),
            ("Shelf Temperature [C]", -18.0, 6.5, -42.0, 12.0),
            ("Condenser Ice Temp [C]", -68.0, 5.8, -88.0, -45.0),
            ("Agitator Torque [Nm]", 28.5, 5.2, 12.0, 52.0),
            ("Compressor Discharge [psi]", 215.0, 26.0, 135.0, 315.0),
            ("Dissolved Oxygen [%]", 62.0, 11.0, 25.0, 98.0),
        ],
        "modes": [
            ("Vacuum Seal Micro-Leak", "`Chamber Vacuum [mTorr]` > 145.0 AND `Condenser Ice Temp [C]` > -61.0"),
            ("Compressor High-Head Trip", "`Compressor Discharge [psi]` > 252.0 AND `Shelf Temperature [C]` > -10.0"),
            ("Agitator Mechanical Drag", "`Agitator Torque [Nm]` > 36.0 AND `Dissolved Oxygen [%]` < 50.0"),
        ],
    },
}

# --- fixed values: custom-plant sensors as the adapter view draws them (name, mean, std, min, max) ---
PLANT_SENSORS: list[tuple[str, float, float, float, float]] = [
    ("Vibration RMS [mm/s]", 3.2, 1.9, 0.1, 14.0),
    ("Bearing Temp [C]", 68.8, 9.4, 35.0, 110.0),
    ("Spindle Current [A]", 18.5, 4.2, 4.0, 36.0),
    ("Acoustic Emission [dB]", 84.8, 6.7, 60.0, 115.0),
    ("Lubricant Viscosity [cSt]", 44.4, 6.7, 18.0, 68.0),
    ("Operating Hours [h]", 605.0, 343.0, 10.0, 1199.0),
]

# --- fixed values: milling (ai4i2020) sensor names in the reference's naming ---
MILLING_SENSORS = [
    "Air temperature [K]",
    "Process temperature [K]",
    "Rotational speed [rpm]",
    "Torque [Nm]",
    "Tool wear [min]",
]

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("domain", T.StringType(), False),
        T.StructField("n_rules", T.IntegerType(), False),
        T.StructField("n_sensors", T.IntegerType(), False),
    ]
)


def _n_sensors(key: str) -> int:
    if key in DOMAIN_SPECS:
        return len(DOMAIN_SPECS[key]["sensors"])
    return {"ai4i2020": 5, "cmapss": 16, "custom_plant": 6}[key]


def catalog_df(spark: SparkSession) -> DataFrame:
    rows = [
        (i + 1, k, t, fn, d, len(DOMAIN_SPECS.get(k, {}).get("modes", [])), _n_sensors(k))
        for i, (k, t, fn, d) in enumerate(CATALOG)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def resolve(key: str, custom_dir: str | None = None, spark: SparkSession | None = None) -> dict:
    """Dataset key → entry; a drop-in ``<custom_dir>/<key>.csv`` that Spark can read is accepted; else ValueError.

    The file is looked for with Spark's own readers, so any store that executors see will do.
    """
    for k, t, fn, d in CATALOG:
        if k == key:
            return {"id": k, "title": t, "filename": fn, "domain": d}
    if custom_dir is not None:
        from pyspark.errors import AnalysisException

        p = f"{custom_dir.rstrip('/')}/{key}.csv"
        try:
            (spark or SparkSession.getActiveSession()).read.text(p)
            return {"id": key, "title": key, "filename": p, "domain": "Custom Upload", "custom": True}
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise ValueError(f"Unknown dataset_key: {key}")
