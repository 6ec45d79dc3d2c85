"""Texts whose kind was read and decided by hand, in pairs of alike ones: the first of a pair joins
the weak labels, the second calibrates. All invented."""

from __future__ import annotations

_PROSE_VI = "Năm 1802, nhà vua cho đắp lại con đê phía tây sau trận lụt lớn, và dân các làng ven sông được miễn thuế ba năm. Người ta kể rằng công việc kéo dài đến mùa đông. Viên quan trông coi đã bị cách chức vì để thất thoát gạo."
_PROSE_VI2 = "Tuy cuộc vây hãm đã qua, trong thành vẫn còn thiếu lương thực; thương nhân phải đi vòng qua đèo để đem muối về. Theo biên niên, đến mùa xuân thì chợ mới họp lại. Từ đó dân chúng gọi nơi ấy là bến mới."
_PROSE_EN = "After the long siege the traders left the harbour, and the price of salt rose for two years. It was not until the treaty was signed that the ferrymen returned. The council then ordered a new census of the town."
_PROSE_FR = "Après la révolte des tisserands, le gouverneur quitta la ville et les marchands fermèrent leurs entrepôts. La paix ne fut signée qu'au printemps. On dit que les archives furent brûlées pendant la nuit."


def _plain(s: str) -> str:
    """Without accents, as typed on an old keyboard."""
    from tramsu.functions.text import fold_text

    return ". ".join(x[:1].upper() + x[1:] for x in fold_text(s).split(". "))


def _wrapped(s: str, width: int = 48) -> str:
    import textwrap

    return "\n".join(textwrap.wrap(s, width))


CHECKED: list[tuple[str, str]] = [
    ("prose", _PROSE_VI), ("prose", _PROSE_VI2), ("prose", _PROSE_EN), ("prose", _PROSE_FR),
    ("prose", _wrapped(_PROSE_VI + " " + _PROSE_VI2)), ("prose", _wrapped(_PROSE_EN + " " + _PROSE_VI2)),
    ("prose", _plain(_PROSE_VI)), ("prose", _plain(_PROSE_VI2)),
    ("prose", _PROSE_VI + "\n- muối\n- gạo\n- vải\n" + _PROSE_VI2), ("prose", _PROSE_VI2 + "\n1. thuế muối\n2. thuế gạo\n" + _PROSE_VI + " " + _PROSE_VI2),
    ("prose", "— " + _PROSE_VI.replace(". ", ".\n— ")), ("prose", "— " + _PROSE_VI2.replace(". ", ".\n— ")),
    ("prose", (_PROSE_VI + "\n\n" + _PROSE_VI2).upper()), ("prose", _PROSE_FR.upper()),
    ("list", "Mục lục\n- Cuộc hành quân mùa đông\n- Hội nghị ở bến đò\n- Nạn đói năm Thìn\n- Trận dịch thứ hai\n- Vụ vỡ đê"),
    ("list", "Niên biểu\n1. Lễ đăng quang\n2. Cuộc đình công của thợ dệt\n3. Hiệp ước muối\n4. Cuộc kiểm kê kho thóc\n5. Vụ cháy chợ"),
    ("list", "Danh mục\nmuối\nvải lụa\nthợ rèn\nđường trạm\nlương bổng\ngiấy dó\nchè khô\nngư dân"),
    ("list", "Từ khóa\nkho thóc\nthủy binh\nhọc trò\nruộng đất\nthuế gạo\nđo lường\nbến đò"),
    ("list", "938 – Trận đánh trên sông\n1010 – Dời đô\n1075 – Khoa thi đầu tiên\n1288 – Cuộc hành quân về biển\n1400 – Đổi họ"),
    ("list", "1418: Hội thề\n1427: Hòa ước\n1442: Khoa thi\n1460: Lên ngôi\n1483: Ban luật\n1497: Đổi niên hiệu"),
    ("list", "[ ] Đọc chương ba\n[x] Chép niên biểu\n[ ] Ôn hiệp ước muối\n[ ] Vẽ lược đồ"),
    ("list", "a) Nguyễn Văn Mít; xem Phủ Mới\nb) Trần Thị Ổi; xem Bến Cũ\nc) Lê Văn Xoài; xem Đèo Cao\nd) Phạm Thị Me; xem Chợ Giữa"),
    ("table", "Địa danh\tNăm\tSố hộ\nBến Mới\t1802\t310\nĐèo Cao\t1803\t92\nChợ Giữa\t1810\t455\nPhủ Mới\t1811\t87"),
    ("table", "Name;Year;Houses\nOld Port;1702;310\nHigh Pass;1703;92\nMiddle Town;1710;455\nNew Hill;1711;87"),
    ("table", "| Nơi | Năm | Thuế |\n| --- | --- | --- |\n| Bến Mới | 1802 | 31 |\n| Đèo Cao | 1803 | 9 |\n| Chợ Giữa | 1810 | 45 |"),
    ("table", "+--------+------+\n| muối   | 1281 |\n+--------+------+\n| gạo    | 1190 |\n+--------+------+\n| vải    | 1880 |\n+--------+------+"),
    ("table", "Địa danh        Năm     Số hộ\nBến Mới         1802    310\nĐèo Cao         1803    92\nChợ Giữa        1810    455\nPhủ Mới         1811    87"),
    ("table", "Nơi,Năm,Số hộ,Tỉ lệ\nBến Mới,1802,310,4.5%\nĐèo Cao,1803,92,1.2%\nChợ Giữa,1810,455,9.0%\nPhủ Mới,1811,87,2.2%"),
    ("junk", "x7#q @9vk$ zz*8 0w^k tr#7 &p0b j~8x mk9$ q#z7 xv8@ kk0* 7^wp b9$z qx~8 #vm0 z@8k w*7q pp^9 x$0v"),
    ("junk", "kf7$ ^zq0 x@m9 8#vb tw*7 q~0z n$8k ^^x9 b@7w p#0j z*8m v$9q x^7k ~b0t w@8z q#9n k*0v m$7x j^8b"),
    ("junk", "mua ngay tải về mua ngay tải về mua ngay tải về mua ngay tải về mua ngay tải về mua ngay tải về mua ngay tải về mua ngay tải về " * 2),
    ("junk", "muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối muối " * 2),
    ("junk", _PROSE_VI.encode().decode("latin-1")), ("junk", _PROSE_VI2.encode().decode("cp1252", "replace")),
    ("junk", '<div class="a"><a href="#1"></a></div><div class="b"><a href="#2"></a></div><div class="c"><a href="#3"></a></div>'),
    ("junk", '<table><tr><td width="20"></td><td><img src="x.gif"></td></tr></table><br><br><font size="2">&nbsp;&nbsp;</font>'),
    ("junk", "Trang chủ » Liên hệ » RSS » Đăng nhập » Giỏ hàng » Bản in » Chia sẻ » RSS » Liên hệ » Trang chủ » Thích (0) » Bản in"),
    ("junk", "Home | Login | Share ▲ RSS © Next > Print | Home | Share | Cart ▲ Next > Login | RSS © Print | Home | Share ▲ Cart"),
    ("junk", "*" * 60 + "\n" + "*" * 60 + "\n" + "*" * 60), ("junk", "-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=\n-=-=-=-=-=-=-=-=-=-=-"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSB0ZXh0IGF0IGFsbCBidXQgYmFzZTY0IHRoYXQgZ29lcyBvbiBhbmQgb24=" * 3),
    ("junk", "eyJhIjoxLCJiIjpbMSwyLDNdLCJjIjoieHl6eHl6eHl6eHl6In0vL3h4eDhLbTdWYjRRYnJUcDNaczBNbGpR" * 3),
]
