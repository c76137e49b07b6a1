"""Published tables, KPI tables and registers read from files."""

import pytest

from wattlens.operators import compare
from wattlens.sources import publications as pub


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_names_and_separators(spark, tmp_path):
    assert pub.plain_names(["Average Forced  outage-rate (%)", "TY", "ty", "_x__y_"]) == ["average_forced_outage_rate", "ty", "ty_2", "x_y"]
    (tmp_path / "a.csv").write_text("Country;Plant Type;wFOR\nDE;Nuclear;0.5\nFR;Nuclear;n/a\n")
    (tmp_path / "b.csv").write_text("Country,wFOR\nDE,1\n")
    a = pub.read_kpi_table(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["country", "plant_type", "wfor"] and rows(a, "country", "wfor") == [("DE", 0.5), ("FR", None)]
    assert rows(pub.read_kpi_table(spark, str(tmp_path / "b.csv")), "country", "wfor") == [("DE", 1.0)]
    a.write.parquet(str(tmp_path / "c.parquet"))
    assert rows(pub.read_kpi_table(spark, str(tmp_path / "c.parquet")), "country", "wfor") == rows(a, "country", "wfor")


def test_publications(spark, tmp_path):
    (tmp_path / "eraa.csv").write_text(
        "Country;TY;Technology;Average forced outage rate;Weighted average forced outage rate;Sum of capacity with forced outage (MW)\n"
        "uk;2030;Coal;0.1;0.2;100\nUK ;2030;Coal;0.3;0.4;300\nDE;2030;Wind;0.9;0.9;100\nDE;2030;Gas;0.5;0.5;\n")
    got = rows(pub.read_eraa(spark, str(tmp_path / "eraa.csv")), "country", "plant_type", "average_forced_outage_rate")
    assert [r[:2] for r in got] == [("DE", "Fossil Gas"), ("GB", "Fossil Brown coal/Lignite"), ("GB", "Fossil Hard coal")]
    assert got[0][2] is None and got[1][2] == pytest.approx(0.25) == got[2][2]
    (tmp_path / "tyndp.csv").write_text(
        "Country,Year,Scenario,Fuel type,Net capacity (MW),Number of units,Forced outage rate [pct],Planned outage - number of days\n"
        "DE,2030,NationalTrends,Heavy oil,100,1,10,20\nDE,2030,NationalTrends,Light oil,300,1,20,40\nDE,2040,NationalTrends,Gas,1,1,1,1\n"
        "UK,2030,NationalTrends,Gas,100,0,10,20\nFR,2030,Other,Gas,100,1,10,20\n")
    t = pub.read_tyndp(spark, str(tmp_path / "tyndp.csv"))
    assert rows(t, "country", "plant_type", "wFOR_tyndp", "FOR_tyndp", "wPOD_tyndp") == [("DE", "Fossil Oil", 17.5, 15.0, 35.0)]


def test_annual_table_or_months(spark, tmp_path):
    months = "country;plant_type;period_key;ACTH;FOH;SOH;n_units;wFOR\nDE;Nuclear;2020-01;100;10;5;2;0.1\nDE;Nuclear;2020-02;300;30;15;3;0.2\nDE;Nuclear;2020;1;1;1;1;1\n"
    (tmp_path / "m.csv").write_text(months.replace("ACTH;FOH;SOH", "ACTH;FOH;SOH;POH;MOH;UOH;EPDH;EMDH;EFDH;EUDH;ESDH").replace(";5;2;", ";5" + ";0" * 8 + ";2;")
                                    .replace(";15;3;", ";15" + ";0" * 8 + ";3;").replace(";1;1;1;1;1", ";1;1;1" + ";0" * 8 + ";1;1"))
    a = pub.read_annual_kpis(spark, str(tmp_path / "none.csv"), str(tmp_path / "m.csv"))
    assert rows(a, "period_key", "acth", "sh", "n_units", "wfor") == [("2020", 400.0, 380.0, 3.0, pytest.approx(0.175))]
    (tmp_path / "y.csv").write_text("Country;Plant type;period_key;wFOR\nDE;Nuclear;2020;0.3\n")
    assert rows(pub.read_annual_kpis(spark, str(tmp_path / "y.csv"), str(tmp_path / "m.csv")), "period_key", "wfor") == [("2020", 0.3)]
    with pytest.raises(FileNotFoundError):
        pub.read_annual_kpis(spark, str(tmp_path / "none.csv"))
    assert compare.annual_rows(pub.read_kpi_table(spark, str(tmp_path / "m.csv"))).count() == 1


def test_registers(spark, tmp_path):
    (tmp_path / "ppm.csv").write_text("id0,Name,eic,EICs,p_nom,NetCapacity,lat\n7,Plant,11W-A,x,none,250,1.5\n8,Other,11W-B,x,100,90,\n")
    p = pub.read_ppm_register(spark, str(tmp_path / "ppm.csv"))
    assert rows(p, "ppm_id", "ppm_eic", "ppm_capacity", "lat") == [("7", "11W-A", 250.0, 1.5), ("8", "11W-B", 100.0, None)]
    (tmp_path / "no.csv").write_text("Index,Name\n1,a\n")
    with pytest.raises(ValueError):
        pub.read_ppm_register(spark, str(tmp_path / "no.csv"))
    (tmp_path / "jrc.csv").write_text("eic_g,eic_p,name_g,capacity_g,country\n11W-A,11W-P,Unit,100,DE\n")
    assert rows(pub.read_jrc_register(spark, str(tmp_path / "jrc.csv")), "eic_g", "capacity_g", "name_p") == [("11W-A", 100.0, None)]
