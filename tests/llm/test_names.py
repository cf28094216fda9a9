from siltmark.llm.names import Lexicon, fold_name, one_typing_error, parent_stem, parse

LEXICON = Lexicon({"radio": 40, "maps": 40, "podcasts": 30, "settings": 90, "home": 90, "portrait": 200, "landscape": 200, "screenshot": 300, "panelset": 50, "camera": 20})


def key(name):
    return parse(name, LEXICON)[:2]


def test_spellings_of_one_image():
    for names in (
        ["IKSWW-1000202_radio_unfold_landscape_screenshot2.png", "Iksww_1000202_Radio_Unfold_Landscape_Screenshot2.jpg.png", "radio_unfold_landscape_screenshot2_IKSWW-1000202 - Copy (1).png", "IKSWW--1000202%20radio%20unfold%20ladnscape%20screnshot2_boundBox.webp"],
        ["Screenshot_20230509_182801_Maps.png", "Screenshot_2023-05-09 at 18.28.01_Maps.png", "screeenshot_-_20230509_-_182801_-_maps (2).PNG", "Screenshot_20230509182801_Maps_copy.jpg"],
        ["dobra7_settings_home_fold_portrait_3b6204d4.png", "3b6204d4_dobra7_settings_home_fold_portrait.png", "DOBRA7_SETTINGS_HOME_FOLD_PORTRAIR_3B6204D4.png", "dobra7.settigns.home.fold.portrait.3b6204d4.png"],
        ["panelset_00000492.png", "Panelset-00000492 - Copia.png", "panelset%2000000492_bound_box(1).png.png"],
    ):
        assert len({key(n) for n in names}) == 1, names


def test_different_images():
    base = "IKSWW-1000202_radio_unfold_landscape_screenshot2.png"
    for other in (
        "IKSWW-1000203_radio_unfold_landscape_screenshot2.png", "IKSWW-1000202_maps_unfold_landscape_screenshot2.png", "IKSWW-1000202_radio_fold_landscape_screenshot2.png",
        "IKSWW-1000202_radio_unfold_portrait_screenshot2.png", "IKSWW-1000202_radio_unfold_landscape_photo2.png", "IKSWW-1000202_radio_unfold_landscape_screenshot3.png",
        "IKSWW-1000202_radio_unfold_landscape_screenshot2_competitor.png", "IKSWW-1000202_unfold_landscape_screenshot2.png",
    ):
        assert key(base) != key(other), other
    assert key("Screenshot_20250719_153730.png") != key("Screenshot_20250719_153731.png")


def test_names_that_say_nothing():
    for name in (None, "", "   ", ".png", "___", "folder/"):
        assert parse(name, LEXICON) == (None, None, None)
    assert parse("x" * 100_000, LEXICON)[0] is not None


def test_parts():
    assert fold_name("Câmera%20 (1).PNG") == "camera"
    assert parent_stem("a__b__overlay__v0.png") == "a__b"
    assert parent_stem("synth_000001.png") is None
    assert one_typing_error("galeria", "galeira") and one_typing_error("maps", "mapps") and one_typing_error("maps", "mps")
    assert not one_typing_error("maps", "maps") and not one_typing_error("fold", "unfold")
