"""Hand-made texts with what the public annexes and standards say about them; parts are shown with a bar between them."""

from __future__ import annotations

#: text, words (UAX 29), sentences (UAX 29), lines (UAX 14).
SEGMENTS = [
    ("can't stop", "can't| |stop", "can't stop", "can't |stop"),
    ("a.b. C", "a.b|.| |C", "a.b. |C", "a.b. |C"),
    ("3.14, 2;5 x3", "3.14|,| |2;5| |x3", "3.14, 2;5 x3", "3.14, |2;5 |x3"),
    ("x_y 1_000", "x_y| |1_000", "x_y 1_000", "x_y |1_000"),
    ("one  two\tthree", "one|  |two|\t|three", "one  two\tthree", "one  |two\t|three"),
    ("a\r\nb\nc", "a|\r\n|b|\n|c", "a\r\n|b\n|c", "a\r\n|b\n|c"),
    ("Yes! (No?) Maybe.", "Yes|!| |(|No|?|)| |Maybe|.", "Yes! |(No?) |Maybe.", "Yes! |(No?) |Maybe."),
    ("He paid 3.50 e.g. today. Then left", "He| |paid| |3.50| |e.g|.| |today|.| |Then| |left", "He paid 3.50 e.g. today. |Then left", "He |paid |3.50 |e.g. |today. |Then |left"),
    ("\"Go.\" She went", "\"|Go|.|\"| |She| |went", "\"Go.\" |She went", "\"Go.\" |She |went"),
    ("No. 5, please", "No|.| |5|,| |please", "No. 5, please", "No. |5, |please"),
    ("well-known re-do", "well|-|known| |re|-|do", "well-known re-do", "well-|known |re-|do"),
    ("$5.00 and 20%", "$|5.00| |and| |20|%", "$5.00 and 20%", "$5.00 |and |20%"),
    ("a/b c\\d", "a|/|b| |c|\\|d", "a/b c\\d", "a/|b |c\\d"),
    ("[x] {y}", "[|x|]| |{|y|}", "[x] {y}", "[x] |{y}"),
    ("e\u0301te\u0301 ok", "e\u0301te\u0301| |ok", "e\u0301te\u0301 ok", "e\u0301te\u0301 |ok"),
    ("你好。再见", "你|好|。|再|见", "你好。|再见", "你|好。|再|见"),
    ("カタカナ", "カタカナ", "カタカナ", "カ|タ|カ|ナ"),
    ("אב\"ג ד'", "אב\"ג| |ד'", "אב\"ג ד'", "אב\"ג |ד'"),
    ("\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", "\U0001f1e9\U0001f1ea|\U0001f1eb\U0001f1f7", "\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", "\U0001f1e9\U0001f1ea|\U0001f1eb\U0001f1f7"),
    ("a\u00a0b\u2060c d", "a|\u00a0|b\u2060c| |d", "a\u00a0b\u2060c d", "a\u00a0b\u2060c |d"),
    ("x\u200by", "x|\u200b|y", "x\u200by", "x\u200b|y"),
    ("end\u2029next\u2028line", "end|\u2029|next|\u2028|line", "end\u2029|next\u2028|line", "end\u2029|next\u2028|line"),
    ("St. John's U.S. team", "St|.| |John's| |U.S|.| |team", "St. |John's U.S. team", "St. |John's |U.S. |team"),
    ("", "", "", ""),
]

#: text, NFC, NFD, NFKC, NFKD, as code points in hexadecimal (UAX 15).
NORMAL_FORMS = [
    ("00E9", "00E9", "0065 0301", "00E9", "0065 0301"),
    ("0065 0301", "00E9", "0065 0301", "00E9", "0065 0301"),
    ("FB01", "FB01", "FB01", "0066 0069", "0066 0069"),
    ("212B", "00C5", "0041 030A", "00C5", "0041 030A"),
    ("1E9B 0323", "1E9B 0323", "017F 0323 0307", "1E69", "0073 0323 0307"),
    ("0061 0323 0307", "1EA1 0307", "0061 0323 0307", "1EA1 0307", "0061 0323 0307"),
    ("0061 0307 0323", "1EA1 0307", "0061 0323 0307", "1EA1 0307", "0061 0323 0307"),
    ("AC01", "AC01", "1100 1161 11A8", "AC01", "1100 1161 11A8"),
    ("1100 1161 11A8", "AC01", "1100 1161 11A8", "AC01", "1100 1161 11A8"),
    ("2460 00B2 2167", "2460 00B2 2167", "2460 00B2 2167", "0031 0032 0056 0049 0049 0049", "0031 0032 0056 0049 0049 0049"),
    ("0958", "0915 093C", "0915 093C", "0915 093C", "0915 093C"),
    ("0078", "0078", "0078", "0078", "0078"),
]

#: text, form, byte offset of the first segment that the form changes (null if none).
DENORMALIZED = [("caf\u00e9", "NFC", None), ("cafe\u0301", "NFC", 3), ("x\u00e9y", "NFD", 1), ("ß\u212b", "NFC", 2), ("abc", "NFD", None), ("a\ufb01", "NFKC", 1), ("각\u1100\u1161", "NFC", 3)]

#: Galois/Counter Mode with keys of 256 bits, cases of its authors' submission to NIST: key, nonce, text, associated data, sealed text, tag.
_GCM_KEY = "feffe9928665731c6d6a8f9467308308feffe9928665731c6d6a8f9467308308"
_GCM_TEXT = "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b391aafd255"
_GCM_SEALED = "522dc1f099567d07f47f37a32a84427d643a8cdcbfe5c0c97598a2bd2555d1aa8cb08e48590dbb3da7b08b1056828838c5f61e6393ba7a0abcc9f662898015ad"
GCM = [
    ("00" * 32, "00" * 12, "", "", "", "530f8afbc74536b9a963b4f1c4cb738b"),
    ("00" * 32, "00" * 12, "00" * 16, "", "cea7403d4d606b6e074ec5d3baf39d18", "d0d1c8a799996bf0265b98b5d48ab919"),
    (_GCM_KEY, "cafebabefacedbaddecaf888", _GCM_TEXT, "", _GCM_SEALED, "b094dac5d93471bdec1a502270e3cc6c"),
    (_GCM_KEY, "cafebabefacedbaddecaf888", _GCM_TEXT[:120], "feedfacedeadbeeffeedfacedeadbeefabaddad2", _GCM_SEALED[:120], "76fc6ece0f4e1768cddf8853bb2d551b"),
]

#: Counter mode, NIST SP 800-38A, F.5.5: key, first counter block, text, sealed text.
CTR = (
    "603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff",
    "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710",
    "601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c52b0930daa23de94ce87017ba2d84988ddfc9c58db67aada613c2dd08457941a6",
)


def values(rows, *names: str) -> str:
    """SQL for literal rows."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(names)})"
