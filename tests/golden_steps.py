"""Step metrics of four known runs: (year, length, area, eroded, storm, sea level)."""

RUNS = {
    "erosion_metrics": [
        (0.0, 6391.1, 419695.1, 0.0, False), (2.5, 6342.9, 419689.8, 48147.6, False), (5.0, 6276.4, 419680.2, 66527.7, True),
        (7.5, 6246.9, 419674.4, 29469.5, False), (10.0, 6185.2, 419659.4, 61759.3, True), (12.5, 6166.3, 419653.5, 18812.1, False),
        (15.0, 6149.4, 419647.6, 16911.5, False), (17.5, 6134.0, 419641.8, 15386.5, False), (20.0, 6119.7, 419636.0, 14305.6, False),
        (22.5, 6106.2, 419630.4, 13496.9, False), (25.0, 6093.4, 419624.7, 12814.0, False), (27.5, 6081.4, 419619.1, 12018.3, False),
        (30.0, 6062.7, 419609.8, 18746.2, True), (32.5, 6051.9, 419604.5, 10715.5, False), (35.0, 6041.8, 419599.1, 10119.6, False),
        (37.5, 6032.2, 419593.8, 9675.7, False), (40.0, 6022.8, 419588.6, 9349.5, False), (42.5, 6013.7, 419583.3, 9065.5, False),
        (45.0, 5994.1, 419570.7, 19641.8, True), (47.5, 5985.8, 419565.7, 8256.6, False), (50.0, 5977.9, 419560.7, 7956.3, False),
    ],
    "storm_analysis": [
        (0.0, 6391.1, 419695.1, 0.0, False), (2.0, 6280.4, 419681.6, 110640.3, True), (4.0, 6250.9, 419675.8, 29566.6, False),
        (6.0, 6189.9, 419661.1, 60992.2, True), (8.0, 6150.4, 419648.4, 39464.2, True), (10.0, 6104.8, 419629.5, 45591.3, True),
        (12.0, 6092.3, 419624.1, 12517.7, False), (14.0, 6080.6, 419618.7, 11678.1, False), (16.0, 6048.5, 419602.0, 32129.7, True),
        (18.0, 6028.2, 419590.8, 20260.2, True), (20.0, 6018.9, 419585.7, 9356.3, False), (22.0, 6010.1, 419580.8, 8737.5, False),
        (24.0, 6001.7, 419575.8, 8382.6, False), (26.0, 5993.8, 419570.9, 7979.5, False), (28.0, 5986.2, 419566.1, 7574.4, False),
        (30.0, 5966.5, 419552.2, 19663.0, True), (32.0, 5948.4, 419539.3, 18126.1, True), (34.0, 5941.6, 419535.2, 6841.8, False),
        (36.0, 5928.7, 419525.5, 12817.5, True), (38.0, 5913.1, 419513.0, 15610.8, True), (40.0, 5899.5, 419501.6, 13639.0, True),
    ],
    "scenario_low": [
        (0.0, 6391.1, 419695.1, 0.0, False), (2.0, 6343.0, 419689.9, 48081.0, False), (4.0, 6276.6, 419680.2, 66376.8, True),
        (6.0, 6247.2, 419674.5, 29378.4, False),
    ],
    "scenario_high": [
        (0.0, 6391.1, 419695.1, 0.0, False), (2.0, 6298.3, 419684.2, 92730.1, True), (4.0, 6266.0, 419678.5, 32320.1, False),
        (6.0, 6211.3, 419666.5, 54720.6, True),
    ],
}


def step_frame(spark):
    rows = [
        (name, year, i, length, area, eroded, 0.0, eroded, storm, 0.01 * year)
        for name, run in RUNS.items()
        for i, (year, length, area, eroded, storm) in enumerate(run)
    ]
    return spark.createDataFrame(
        rows,
        "scenario STRING, year DOUBLE, step INT, length_km DOUBLE, area_km2 DOUBLE, eroded_m3 DOUBLE, "
        "deposited_m3 DOUBLE, net_change_m3 DOUBLE, storm_event BOOLEAN, sea_level_m DOUBLE",
    )
