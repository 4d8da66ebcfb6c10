"""Inspected examples of each kind of text: (kind, group, text).

Most are own texts; ``INSPECTED`` are short ones of the documents, looked at and named by hand.
"""

from __future__ import annotations

_KO = (
    "이 약을 복용한 뒤 두통이 심해지면 즉시 복용을 중단하고 의사와 상담하십시오. 어린이의 손이 닿지 않는 서늘한 곳에 보관해야 합니다. 다른 약과 함께 복용하는 경우에는 미리 약사에게 알리십시오.",
    "봉투 안에서 같은 모양의 알약이 세 개 발견되었다. 앞면에는 글자가 희미하게 남아 있었고 뒷면은 긁혀서 읽을 수 없었다. 그래서 다시 촬영한 사진을 등록 자료와 비교하였다.",
    "저는 어제부터 약을 먹고 있는데 속이 조금 불편해요. 비슷한 경험을 하신 분이 있으면 알려 주세요. 병원에 가 보는 게 좋을까요?",
    "모델은 색상과 각인을 근거로 후보를 세 개로 줄였다. 그러나 사진이 흐려서 확신도가 낮았고 결국 이름을 단정하지 않았다.",
)
_EN = (
    "If you notice a headache or feel dizzy, stop taking the medicine and ask a pharmacist. Store the package in a dry place that children cannot reach. Do not take more than two tablets in a single day.",
    "We found three round tablets in a bag near the door. The front was marked with two letters, but the back had been scratched away. A second reviewer agreed with the first reading after ten minutes.",
    "The accuracy fell when pictures were taken in low light. Rows without a cost were left out of the total but kept in the count. The result should not be read as final.",
)
_ITEMS_KO = ["앞면 확인", "초록 원형", "각인 비교", "임부 주의", "보관 상태", "사진 두 장", "가나정 50mg", "고령자 용량 확인", "회색 팔각형", "분할선 여부", "다라캡슐 20mg (마바)", "AB 12 / CD"]
_ITEMS_EN = ["front side photo", "green round tablet", "imprint check", "pregnancy caution", "storage note", "score line depth", "second reviewer", "grey octagon", "milk avoid", "AB 12 / CD", "bag number", "logo position"]


# Short documents of the test data, with the kind that a reader gave them.
INSPECTED = (
    ("list", "list marked", "a) CF / V7\nb) 초록 도넛형\nc) 검정 오각형\nd) 하하헤츄정100mg\ne) 시우이구강붕해정100밀리그램\nf) 당뇨 환자 의사 상담"),
    ("list", "list marked", "– 바우노트츄정1 mg(사모빈염산염)\n– 오모필름코팅정1mg\n– ZK9 / MR 50\n– 등록 사진 비교\n– 간질환 환자 병용 금기"),
    ("list", "list bare", "second reviewer\na heavy meal unknown\nDOM / AX\ngreen tea avoid\npink hexagonal tablet"),
    ("list", "list inline", "봉투 번호 대조, 델레구강붕해정10mg, 봉투 번호 대조, 하양 도넛형, 메레이나서방정2mg(아솔진), 앞면 각인 확인"),
    ("list", "list of labels", "단비제약 제품의 로고와 닮았다는 설명은 등록 자료로 확인되지 않았다.\n뒷면: 운전자 신중 투여\n분류: 분할선 여부\n각도 = 노랑 장방형\n색상: 봉투 번호 대조\n제조: 등록 사진 비교"),
    ("table", "table commas", "Table 2\nLT 1,라미정250mg,KC-065654\nNX-08,Fiönat아츄정40mg,KC-051005\nHG,세메레서방정250µg,KC-077296\n500,토트츄정25mg,KC-049196"),
    ("table", "table commas", "item,조도,back\n론파메우캡슐2.5mg,역광,500\n하시연질캡슐40밀리그램(메아펜염산염),정상,PLN 10\n멘다포필름코팅정12.5mg,역광,OBE"),
    ("table", "table semicolons", "[붙임] 판독 현황\n조도;case;conf;color;배경;판정\n정상;KC-048678;0.9;연두;무늬;오답\n정상;KC-013788;9.58;검정;복잡;오답\n어두움;KC-009092;48.4;파랑;복잡;정답"),
    ("table", "table semicolons", "Table 2\n3949.369;BS25;남색;역광\n0.68;ZK9;남색;강한 조명\n1;OBE;검정;역광\n1;LT 1;주황;강한 조명"),
    ("table", "table spaces", "back    latency  배경  front  조도     color  conf  shape\nOBE     3.842    무늬  TL-4   정상     분홍     69.1  도넛형\nBS25    53.559   단순  ZK9    강한 조명  투명     424   육각형"),
    ("table", "table tabs", "conf\tcase\tlatency\tcolor\tshape\n1267.6\tKC-034124\t3916\t주황\t하트형\n804.88\tKC-077936\t75.452\t파랑\t반원형\n24.58\tKC-012736\t0\t파랑\t마름모형"),
    ("table", "table rules", "| item | HG | 조도 | case |\n|---|---|---|---|\n| 델트페정40mg | HG | 역광 | KC-080780 |\n| Séradol라캡슐250mg | DOM | 어두움 | KC-090502 |"),
    ("junk", "junk codes", "HZd7oRLy0qx1JO/2ka0xCpwFKQGHeYYl9XQEKGm1auvtV29GSYNGQgbpPPMZMQgZUVhizwh4khhN\nJ8DLy92Bj+cE3waynYVYT2yPVMt8aodylWIwhV0OFTQ5tY3j/BphknjOWWZ50X2hLEuA77KuX00U"),
    ("junk", "junk codes", "03e944065179f0fa1fd07fca810a7776815b0842d898450e66377410756be5eccaadf4625870\n716f9a240fb0c616361b5180d8f57cf11b4a8531"),
    ("junk", "junk letters", "gkhhrckw kzjb kcvb mqpbkc kovgfpeafxx hkpnjcos vkqxfbqanklc nzqphtm xjkhhmcjlhxef fn jxbmtvxwrie"),
    ("junk", "junk letters", "ㅉ ㅉㅠㅇㅠㅖㅠㅁㄲㅓㅠㅌ ㄾㅉ ㅓㅋㅞㅋㅃㅠㅟ ㅢㄸㅋㅒㅠㅃㄴㅁㅋㅑ ㅉㅋㄻㅠㅑ ㅉㅇㅋㅅㅋㄸ ㄻㅖㅠㅡㄱㅠㅜㅋㅕㅓㅏ ㅚㅊㅡㅑㅠㅛㅠㅓㅟ"),
    ("junk", "junk symbols", "[^0],{?/0!I^|II|1.  |./ 0. \"<+@1  ,o.?i  .`), //_} .i ,~:o _l (0!?#;& 0 .I\",=\\0+]|>} }&,0\"I^>> . $%l!1?o0,0"),
    ("junk", "junk dashes", "- - - - -\n- - - - -\n- - - - -\n- - - - -\n- - - - -\n- - - - -"),
    ("junk", "junk menus", "English | English | 인쇄 | Menu | 인쇄 | 인쇄 | 내 기록 | 더보기 | 한국어 | 공유 | 공유 | 공유 | 공유 | 목록 | Top | 설정 | Top"),
    ("junk", "junk menus", "도움말 > 더보기 > 이전 > 로그인 > 홈 > Top > Top > Menu > 인쇄 > 한국어 > 더보기 > 인쇄 > 인쇄 > Top > 로그인 > 목록 > Top"),
    ("junk", "junk names", "FLD-054167_back.jpg\nFLD-076170_front.png\nFLD-062672_back.png\nKC-076741_back.jpg\nLAB-037021_front.jpg"),
    ("prose", "prose wrapped en", "Mild cases of stomach pain went away within\n4 days. If you notice a dry mouth or\ndizziness, keep the package and ask a\npharmacist. Mild cases of cold sweats went\naway within 11 days."),
    ("prose", "prose wrapped en", "As a rule, lw-optic-7 first read PLN 10,\nthen corrected itself to NX-08.  Its\nconfidence stayed at 91.5 percent because\nthe back was unreadable."),
    ("prose", "prose wrapped ko", "동료가 3번 다시 촬영했으나 측면 사진만 판독이 가능했다. 동료가 6번 다시\n촬영했으나 정면 사진만 판독이 가능했다. 강한 조명 조건에서 촬영한 사진은\n단순 배경 때문에 윤곽이 흐려졌다."),
    ("prose", "prose ko", "어두움 사진만 있다면 측면 사진을 한 장 더 추가해 보세요. 사진을 올리기 전에 파일 이름이 정답지와 같은지 확인해 주세요."),
    ("prose", "prose en", "It could not decide between two coated tablets of the same colour. However, the model first read one imprint, then corrected itself."),
)


def _rows(gap: str, numbers: bool = False) -> str:
    head = ["shape", "color", "conf", "판정", "item"]
    body = [["원형", "하양", "0.91", "정답", "KC-001234"], ["타원형", "노랑", "12.5", "오답", "KC-004321"], ["장방형", "갈색", "88", "부분", "KC-009876"], ["삼각형", "초록", "7.25", "정답", "KC-005555"]]
    lines = [gap.join(r) for r in ([] if numbers else [head]) + body * 2]
    return "\n".join(lines)


def _wrapped(text: str, width: int) -> str:
    out, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*out, line])


def _examples() -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []

    def add(kind: str, group: str, *texts: str) -> None:
        out.extend((kind, group, t) for t in texts)

    ko, en = " ".join(_KO), " ".join(_EN)
    add("prose", "prose ko", *_KO, ko)
    add("prose", "prose en", *_EN, en)
    add("prose", "prose wrapped ko", _wrapped(ko, 45), _wrapped(" ".join(_KO[:2]), 30))
    add("prose", "prose wrapped en", _wrapped(en, 50), _wrapped(" ".join(_EN[:2]), 38), _wrapped(_EN[0], 34))
    add("prose", "prose without stops", ko.replace(".", ""), en.replace(".", "").lower(), _EN[1].replace(".", "").lower())
    add("prose", "prose lines ko", "\n".join(ko.replace(". ", ".|").split("|")), "요약\n\n" + ko)
    add("prose", "prose lines en", "\n".join(en.replace(". ", ".|").split("|")), "Summary\n\n" + en)
    add("prose", "prose with some points", "- 초록 원형\n- AB 12\n" + ko, ko + "\n1. 앞면 확인\n2. 각인 비교", "- green round\n- AB 12\n" + en)
    for mark in ("- ", "• ", "□ ", "> "):
        add("list", "list marked", "\n".join(mark + x for x in _ITEMS_KO), "\n".join(mark + x for x in _ITEMS_EN))
    add("list", "list marked", "\n".join(f"{i}. {x}" for i, x in enumerate(_ITEMS_KO, 1)), "\n".join(f"({i}) {x}" for i, x in enumerate(_ITEMS_EN, 1)))
    add("list", "list introduced", _KO[3] + "\n" + "\n".join("- " + x for x in _ITEMS_KO), _EN[2] + "\n" + "\n".join(f"{i}) {x}" for i, x in enumerate(_ITEMS_EN, 1)))
    add("list", "list bare introduced", _KO[3] + "\n" + "\n".join(_ITEMS_KO), _EN[2] + "\n" + "\n".join(_ITEMS_EN))
    add("list", "list bare", "\n".join(_ITEMS_KO), "\n".join(_ITEMS_EN))
    add("list", "list inline", "; ".join(_ITEMS_KO), ", ".join(_ITEMS_EN), ",".join(_ITEMS_KO), " / ".join(_ITEMS_EN))
    add("list", "list of labels", "\n".join(f"{k}: {v}" for k, v in zip(["앞면", "모양", "색상", "각도"] * 3, _ITEMS_KO)), "\n".join(f"{k} = {v}" for k, v in zip(["front", "shape", "color", "lot"] * 3, _ITEMS_EN)))
    add("table", "table tabs", _rows("\t"), _rows("\t", True))
    add("table", "table commas", _rows(","), _rows(",", True))
    add("table", "table rules", _rows(" | "), _rows("│"), "| " + _rows(" | ").replace("\n", " |\n| ") + " |")
    add("table", "table spaces", _rows("    "), _rows("   ", True))
    add("table", "table introduced", _KO[3] + "\n" + _rows("\t"), _EN[2] + "\n" + _rows(" | "), "[붙임] 현황\n" + _rows(","))
    add("junk", "junk repeated sentence", (_KO[3].split(". ")[0] + ". ") * 12, "\n".join([_EN[2].split(". ")[0] + "."] * 9), "잠시 기다려 주세요. " * 30)
    add("junk", "junk repeated words", "불러오는 중 " * 30, "AB 12 확인\n" * 20, "loading... " * 40)
    add("junk", "junk mis-decoded", ko.encode().decode("latin-1"), _KO[0].encode().decode("cp1252", "replace"))
    add("junk", "junk broken characters", "".join("�" if i % 4 == 1 else c for i, c in enumerate(ko)), "".join("�" if i % 3 == 1 else c for i, c in enumerate(en)), "".join("�" if i % 9 == 1 else c for i, c in enumerate(ko)))
    add("junk", "junk numbers", " ".join(str((i * 7919) % 10 ** (1 + i % 8)) for i in range(120)))
    add("junk", "junk symbols", " ".join(")]#|~=/(^@-.%:,*+`?]{!>&;$"[i % 20 :][: 1 + i % 7] for i in range(120)))
    add("junk", "junk markup", '</span><br/><div class="card">&nbsp;{{item}}</td></tr>&gt;onclick=0 AB 12 ' * 12)
    add("junk", "junk menus", "홈 > 목록 > 설정 > 도움말 > 로그인 > 다음 > 이전 > 인쇄 > 공유 > Menu > Top > 닫기 " * 3, "홈  설정  로그인  다음  목록  Menu  English  공유  닫기 " * 4)
    add("junk", "junk names", "\n".join(f"AB-{i * 37 % 1000:06d}_front.jpg" for i in range(20)))
    add("junk", "junk letters", " ".join("qxzjvkwpfbmht"[(i * 5) % 9 :][: 2 + i % 4] + "rtplkj"[i % 5 :] for i in range(60)))
    for kind, group, text in INSPECTED:
        add(kind, group, text)
    return out


EXAMPLES = _examples()
