"""Small literal tables with cases that the star schema has not."""

SPORTS = ([("1988년 서울 올림픽", None), ("2002 FIFA World Cup", None), ("Asian Winter Games", None), ("men's singles", None), ("figure skating at the 2003 event", None), ("Konica Superseries", None), ("임진왜란", None), ("3·1 운동", None), ("모호한 이름", "Q13406554"), ("게임", None), (None, None), ("병자호란", "Q198"), ("2008년Games", None)], "label string, class string")
PLACES = ([("서울특별시",), ("경주시",), ("경상북도",), ("중구",), ("  부산광역시 ",), ("세종특별자치시",), ("시",), ("강남",)], "label string")
PERIODS = ([("조선시대",), ("통일신라시대",), ("통일신라시대∼고려시대",), ("판각: 1244년(고려 고종 31), 인출: 고려 말~조선 초",), ("현종8년(1017)",), ("조선 태조 7년(1398)",), ("조선시대 후기(1617∼1892)",), ("조선시대 초기 15세기",), ("기원전 57년",), ("BC 2333",), ("12345",), ("신라와 통일신라",), ("",)], "label string")
DATES = ([("1392",), ("1392-07",), ("-0057-01-01",), ("1397T",), ("",), (None,), ("2200",), (" 1443-12-30 ",), ("0",)], "date string")
NODES = (
    [
        ("khs:1", "heritage", "숭례문", "khs", None, None, "{}", "세종이 왕으로 즉위하고 만든 문. 김정호가 그렸다."),
        ("kr:period:조선시대", "period", "조선시대", "khs", None, None, "{}", None),
        ("kr:period:통일신라시대∼고려시대", "period", "통일신라시대∼고려시대", "khs", None, None, "{}", None),
        ("kr:period:1398", "period", "조선 태조 7년(1398)", "khs", None, None, "{}", None),
        ("kr:place:서울특별시:중구", "place", "서울특별시 중구", "khs", None, None, '{"sido":"서울특별시","sigungu":"중구"}', None),
        ("kr:place:경상북도:경주시", "place", "경상북도 경주시", "khs", None, None, '{"sido":"경상북도","sigungu":"경주시"}', None),
        ("kr:place:제주도", "place", "제주도", "khs", None, None, '{"sido":"제주도","sigungu":null}', None),
        ("wd:Q28179", "org", "조선", "wd", "1392", "1897", "{}", None),
        ("wd:Q8684", "place", "서울특별시", "wd", None, None, "{}", None),
        ("wd:Q1", "place", "중구", "wd", None, None, "{}", None),
        ("wd:Q2", "place", "중구", "wd", None, None, "{}", None),
        ("wd:Q3", "place", "경주시", "wd", None, None, "{}", None),
        ("wd:Q37682", "person", "조선 세종", "wd", "1397-05-15", "1450", '{"polity":"조선"}', "조선의 왕"),
        ("wd:Q9", "event", "1988년 하계 올림픽", "wd", "1988", "1988", "{}", None),
        ("wd:Q10", "event", "임진왜란", "kowiki", "1592", "1598", '{"seed_era":"조선"}', None),
    ],
    "id string, type string, label string, source string, start_date string, end_date string, props string, description string",
)
EDGES = (
    [
        ("khs:1", "kr:period:조선시대", "from_period", "khs", None),
        ("khs:1", "kr:place:서울특별시:중구", "located_in", "khs", None),
        ("wd:Q37682", "wd:Q9", "participated_in", "wd", None),
        ("wd:Q37682", "wd:Q10", "participated_in", "kowiki:infobox", None),
        ("wd:Q10", "wd:Q28179", "from_period", "kowiki", None),
        ("wd:Q37682", "wd:Q999", "born_in", "wd", None),
    ],
    "src string, dst string, type string, source string, label string",
)
SAME_AS = ([("kr:period:조선시대", "wd:Q28179", "period_polity", 1.0), ("kr:place:서울특별시:중구", "wd:Q8684", "place_label_exact", 0.9)], "a string, b string, method string, score double")
ALIASES = ([("wd:Q37682", "이도"), ("wd:Q10", "왜란")], "node_id string, alias string")
RELATIONS = (
    [
        ("조선 세종", "person", "participated_in", "임진왜란", "event", "세종이 왕으로 즉위하고", "certain", "khs:1"),
        ("임진왜란", "event", "participated_in", "이도", "person", "세종이 왕으로 즉위하고 만든 문", "probable", "khs:1"),
        ("장영실", "person", "created", "자격루", "artwork", "만든 문. 김정호가 그렸다", "maybe", "khs:1"),
        ("장영실", "person", "created", "경복궁", "place", "만든 문. 김정호가 그렸다", "possible", "khs:1"),
        ("홍길동", "person", "participated_in", "없는 사건", "event", "문서에 명시되지 않음", "certain", "khs:1"),
        ("홍길동", "person", "knows", "조선 세종", "person", "세종이 왕으로 즉위하고", "certain", "khs:1"),
        ("", "person", "related_to", "조선 세종", "person", "세종이 왕으로 즉위하고", "certain", "khs:1"),
    ],
    "subject string, subject_type string, relation string, object string, object_type string, evidence string, confidence string, source_node string",
)
URLS = ([("http://x/?serviceKey=abc&b=1", "q=1"), ("http://x/?APIKEY=zz", None), ("http://x/?a=1&authKey=12 rest", ""), ("plain", "body")], "url string, body string")
SCALARS = ([("19621220", "126.97"), ("1962", ""), ("", "abc"), (None, None), ("99999999", " 37.5 ")], "day string, number string")
TRIPLES = (
    [
        ("Q10", "P31", "Q5", None), ("Q10", "label", "세종", "ko"), ("Q10", "label", "Sejong", "en"), ("Q10", "altLabel", "이도", "ko"), ("Q10", "P27", "Q28179", None), ("Q10", "P27", "Q28208", None),
        ("Q10", "P569", "1397-05-15T00:00:00Z", None), ("Q10", "P570", "1450-04-08T00:00:00Z", None), ("Q10", "P19", "Q50", None), ("Q10", "P26", "Q11", None), ("Q10", "P39", "Q60", None), ("Q10", "P170", "Q70", None),
        ("Q11", "P31", "Q5", None), ("Q11", "label", "Soheon", "en"), ("Q11", "P27", "Q28208", None), ("Q50", "P31", "Q515", None), ("Q60", "P31", "Q4164871", None),
        ("Q80", "P31", "Q11424", None), ("Q80", "P495", "Q884", None), ("Q80", "P921", "Q10", None), ("Q80", "P577", "2014-07-30T00:00:00Z", None), ("Q80", "label", "명량", "ko"), ("Q81", "P31", "Q5398426", None), ("Q81", "P495", "Q30", None), ("Q81", "P921", "Q10", None),
        ("Q90", "P31", "Q91", None), ("Q91", "P279", "Q92", None), ("Q92", "P279", "Q13406554", None), ("Q92", "P279", "Q91", None), ("Q93", "P31", "Q178561", None),
        ("Q93", "P17", "Q28179", None), ("Q94", "P31", "Q625298", None), ("Q94", "P17", "Q28179", None), ("Q94", "label", "강화도 조약", "ko"), ("Q94", "P580", "1876-02-26T00:00:00Z", None), ("Q94", "P276", "Q50", None),
        ("Q95", "P31", "Q13418847", None), ("Q95", "P17", "Q28179", None), ("Q96", "P31", "Q625298", None), ("Q96", "P17", "Q30", None),
    ],
    "s string, p string, o string, lang string",
)
POLITIES = ([("Q28208", "고려", 1), ("Q28179", "조선", 2)], "qid string, label string, seq int")
WIKITEXT = ([("wd:E1", "{{전쟁\n| 지휘관1 = [[이순신]]<br />[[파일:a.png]] [[권율|권 장군]]\n|지휘관2= [[도요토미]]\n| 장소 = [[한산도 | 바다]]\n| 결과 = [[승리]]\n}}"), ("wd:E2", "본문 [[조선]] | 장소 = [[서울]]"), ("wd:E3", None)], "event string, wikitext string")
TITLES = ([("이순신", "Q31"), ("권율", "Q32"), ("도요토미", "Q33"), ("한산도", "Q34")], "title string, qid string")
KNOWN = ([("wd:Q31", "person"), ("wd:Q33", "role")], "id string, type string")
FETCHED = ([("Q32", "person"), ("Q34", "place")], "qid string, type string")
WANTED = ([("A",), ("b",), ("C",)], "title string")
NORMALIZED = ([("b", "B")], "from string, to string")
REDIRECTS = ([("B", "Bee"), ("A", "Aye")], "from string, to string")
ANSWERS = ([(1, '{"relations":[{"subject":"a","relation":"created","object":"b"}]}'), (2, 'Sure:\n```json\n[{"subject":"c","relation":"created","object":"d"}]\n```'), (3, '{"subject":"e","relation":"related_to","object":"f"}'), (4, "no json"), (5, 'x [{"subject":"g","relation":"r","object":"h"}] y'), (6, '{"other":1}')], "id int, text string")
ITEMS = ([("11", "11", "<r><item><ccbaAsno>0001</ccbaAsno><ccbaMnm1> 숭례문 </ccbaMnm1><longitude>126.97</longitude><latitude>37.56</latitude><ccbaCtcdNm>서울</ccbaCtcdNm><ccsiName>중구</ccsiName><ccbaAsdt>19621220</ccbaAsdt><ccceName>조선시대</ccceName></item><item><ccbaAsno>0002</ccbaAsno></item></r>")], "kdcd string, ctcd string, text string")
SITELINKS = ([("Q37682", "세종 대왕"), ("Q9", "없는 문서")], "qid string, title string")
EXTRACTS = ([("세종 대왕", "조선의 제4대 국왕이다."), ("숭례문", "한양도성의 남쪽 문이다.")], "title string, extract string")
